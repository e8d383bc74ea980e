"""veilspark: a PySpark engine that de-identifies text tables and prepares training data.

Functions that run in Python workers are pickled by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
