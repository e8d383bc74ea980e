"""Documents from files of pages, and the quarantine of what has no text."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Policy

LEAST_CHARS = 20


def form_feed_pages(content: bytes) -> list[str] | None:
    """The stand-in extractor: UTF-8 text with form feeds between pages; null if it is neither."""
    try:
        return content.decode("utf-8").split("\f") if content else None
    except UnicodeDecodeError:
        return None


def read(spark: SparkSession, path: str, extract: Callable[[bytes], list[str] | None] = form_feed_pages) -> DataFrame:
    """(path, pages, text, error): files through a page extractor. Empty files are ``empty``, those that the
    extractor refuses ``malformed``. A PDF library can be put in as ``extract``."""

    @F.pandas_udf("array<string>")
    def pages(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: extract(bytes(c)))

    table = spark.read.format("binaryFile").load(path)
    files = table.select("path", pages("content").alias("pages"))
    error = F.when(F.col("pages").isNull(), "malformed")
    files = files.select("path", "pages", F.array_join("pages", "\n").alias("text"), error.alias("error"))
    # the reader passes over files without a byte; the listing has them
    listed = [(re.sub(r"^(\w+):/{3}", r"\1:/", unquote(p)),) for p in table.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(table.select("path"), "path", "left_anti")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in files.dtypes if c in ("pages", "text")]
    return files.union(empty.select("path", *nothing, F.lit("empty").alias("error")))


def quarantine(docs: DataFrame, policy: Policy | None = None, text: str = "text", pages: str | None = None) -> DataFrame:
    """``docs`` with quarantined: fewer than 20 characters of text besides white space, or (with
    ``pages``) a larger share of pages like that than the policy allows."""
    policy = policy or Policy()
    bare = lambda c: F.char_length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    out = bare(F.col(text)) < LEAST_CHARS
    if pages:
        empty = F.size(F.filter(pages, lambda p: bare(p) == 0))
        out = out | (empty > policy.quarantine_threshold * F.size(pages))
    return docs.withColumn("quarantined", F.coalesce(out, F.lit(True)))
