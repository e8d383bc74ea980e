"""Column functions on text: matches with offsets, literal patterns, splicing, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START, _VALUE, _END = "\u0001", "\u0002", "\u0003"
_MATCHES = "array<struct<start:int,end:int,text:string>>"


def plain(text: Column) -> Column:
    """``text`` without the three control characters that mark matches; lengths stay."""
    return F.translate(text, _START + _VALUE + _END, "   ")


def matches(text: Column, pattern: Column | str, trim: str = "") -> Column:
    """All matches of a Java pattern with the groups ``anc`` and ``val`` as array<struct<start,end,
    text>> of the value, with code-point offsets; characters of ``trim`` are cut from its end and
    empty values left out. ``text`` must be :func:`plain`.

    One pass of the pattern puts marks around label and value; lengths between marks give the
    offsets. The marked text is named once: in an expression of array functions each mention is a
    further pass.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(text, pattern, F.lit(_START + "${anc}" + _VALUE + "${val}" + _END))
    none = F.array().cast(_MATCHES)

    def parts(piece: Column) -> Column:
        value = F.substring_index(F.substring_index(piece, _END, 1), _VALUE, -1)
        return F.struct(F.length(piece).alias("n"), F.length(F.substring_index(piece, _VALUE, 1)).alias("label"), (F.rtrim(value, F.lit(trim)) if trim else value).alias("value"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + p["label"]
        found = F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("text"))
        out = F.when(p["value"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(found)))
        later = F.struct((acc["pos"] + p["n"] - 2).alias("pos"), out.alias("out"))
        # what stands before the first mark is no match
        return F.when(acc["pos"] < 0, F.struct(p["n"].alias("pos"), acc["out"].alias("out"))).otherwise(later)

    first = F.struct(F.lit(-1).alias("pos"), F.coalesce(F.lit(None).cast(_MATCHES), none).alias("out"))
    return F.coalesce(F.aggregate(F.transform(F.split(marked, _START, -1), parts), first, step, lambda acc: acc["out"]), none)


def quoted(text: Column) -> Column:
    """``text`` as a literal inside a Java pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def as_word(needle: Column) -> Column:
    """A pattern for the whole words ``needle``, with the groups of :func:`matches`. The needle is looked for before the word
    boundary, which costs far more at each place."""
    return F.concat(F.lit(r"(?U)(?<anc>)(?="), quoted(needle), F.lit(r")(?<val>\b"), quoted(needle), F.lit(r"\b)"))


def replacement(text: Column) -> Column:
    """``text`` as a literal replacement."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def exploded(df: DataFrame, array: str, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and a row for each element of ``array``, as ``name``. An outer explode: for an inner
    one the optimizer infers a filter on the array's size and pushes it, with all that the array
    is made of, down through every step."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def words(text: Column) -> Column:
    """The parts of ``text`` between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def splice(text: Column, plan: Column) -> Column:
    """``text`` with the disjoint spans of ``plan`` (sorted by start) replaced."""

    def step(acc: Column, p: Column) -> Column:
        gap = F.substr(text, acc["pos"] + 1, p["start"] - acc["pos"])
        return F.struct(F.concat(acc["out"], gap, p["replacement"]).alias("out"), p["end"].alias("pos"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(text, acc["pos"] + 1))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    return F.when(F.size(plan) == 0, text).otherwise(F.aggregate(plan, first, step, rest))
