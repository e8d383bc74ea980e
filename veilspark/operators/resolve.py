"""Which of the overlapping spans stay, and which are labels rather than names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import words
from ..schema import SPANS


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """A disjoint subset: the most confident first, then the longest, the first, the earliest
    emitted; each is kept unless one kept before overlaps it. Sorted by start. (``sort_array`` compares rows
    directly, ``array_sort`` by an expression that is evaluated for each pair.)"""
    ranked = F.sort_array(F.transform(spans, lambda s: F.struct((-s["confidence"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["ord"].alias("d"), s.alias("s"))))
    none = F.slice(spans, 1, 0)
    kept = F.aggregate(ranked, none, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(x["s"], k)), acc).otherwise(F.concat(acc, F.array(x["s"]))))
    return F.when(F.size(spans) == 0, spans).otherwise(F.sort_array(kept)).cast(SPANS)


def bare(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.regexp_replace(word, "^[.,'’]+|[.,'’]+$", "")


def without_labels(spans: Column) -> Column:
    """Spans that are no names made of one label word."""

    def is_label(s: Column) -> Column:
        parts = words(s["text"])
        return (s["entity_type"] == "NAME") & (F.size(parts) == 1) & F.lower(bare(F.get(parts, F.lit(0)))).isin(vocab.LABEL_WORDS)

    return F.filter(spans, lambda s: ~F.coalesce(is_label(s), F.lit(False)))
