"""Names across a document: further mentions of known names, and clusters of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import as_word, matches, words
from ..schema import SPANS
from .resolve import bare

_LATE = 1_000_000_000  # ``ord`` of propagated spans: after all detected ones
ENTITY = "struct<start:int,end:int,entity_type:string,text:string,confidence:double,source:string,ord:int,cluster_id:string,canonical:string>"


def _honorific(word: Column) -> Column:
    return F.lower(bare(word)).isin([h.lower() for h in vocab.HONORIFICS])


def surface(text: Column) -> Column:
    """A name without honorifics, its words joined by spaces."""
    return F.array_join(F.filter(words(text), lambda w: ~_honorific(w)), " ")


def tokens(text: Column) -> Column:
    """The lower-case words of a name without honorifics and punctuation."""
    return F.filter(F.transform(words(text), lambda w: F.lower(bare(w))), lambda t: (t != "") & ~t.isin([h.lower() for h in vocab.HONORIFICS]))


def names_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["entity_type"] == "NAME")


def needles(spans: Column) -> tuple[Column, Column]:
    """The full names, and their parts that may be looked for alone."""
    cleaned = F.transform(names_of(spans), lambda s: surface(s["text"]))
    full = F.array_distinct(F.filter(cleaned, lambda c: F.size(words(c)) >= 2))
    single = F.transform(F.flatten(F.transform(cleaned, words)), bare)
    fit = F.filter(single, lambda w: (F.length(w) >= 2) & F.regexp_like(w, F.lit(r"^\p{Lu}")) & ~F.lower(w).isin(vocab.COMMON_NAMES))
    return full, F.array_distinct(fit)


def propagate(text: Column, spans: Column, full: Column, parts: Column) -> Column:
    """``spans`` and a NAME span for each place in ``text`` (plain) where a known name or a part of one stands
    as whole words; the :func:`needles` are columns of their own."""

    def mentions(found: Column, confidence: float) -> Column:
        return F.flatten(
            F.transform(
                found,
                lambda n: F.transform(
                    matches(text, as_word(n)),
                    lambda m: F.struct(m["start"], m["end"], F.lit("NAME"), m["text"], F.lit(confidence), F.lit("propagated"), F.lit(_LATE)),
                ),
            )
        ).cast(SPANS)

    return F.when(F.size(full) + F.size(parts) == 0, spans).otherwise(F.concat(spans, mentions(full, 0.9), mentions(parts, 0.85)))


def with_clusters(df: DataFrame, spans: str, into: str) -> DataFrame:
    """``df`` with the array of spans ``spans`` as ``into``, with cluster_id and canonical (null for what is no name).

    A mention of one word joins the only full name that holds the word; a word that several full
    names hold, or none, is a cluster of its own. Clusters are numbered as they come; the canonical
    form is the mention with most words, then most characters, then the first.
    """
    names = F.transform(names_of(F.col(spans)), lambda s: F.struct(s["start"].alias("start"), surface(s["text"]).alias("surface"), tokens(s["text"]).alias("t")))
    full = F.filter("_names", lambda n: F.size(n["t"]) >= 2)
    whole = F.array_distinct(F.transform(full, lambda n: F.sort_array(F.array_distinct(n["t"]))))

    def key(t: Column) -> Column:
        first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
        alone = F.filter("_whole", lambda f: F.array_contains(f, first))
        name = F.array_join(F.when(F.size(t) >= 2, F.sort_array(F.array_distinct(t))).otherwise(F.when(F.size(alone) == 1, F.get(alone, F.lit(0)))), " ")
        return F.coalesce(F.concat(F.lit("full:"), name), F.concat(F.lit("part:"), first))

    keyed = F.transform("_names", lambda n, i: F.struct(n["start"].alias("start"), key(n["t"]).alias("key"), F.size(words(n["surface"])).alias("n"), F.length(n["surface"]).alias("len"), (-i).alias("i"), n["surface"].alias("surface")))
    ranked = lambda k: F.array_max(F.transform(F.filter("_keyed", lambda x: x["key"] == k), lambda x: F.struct(x["n"].alias("n"), x["len"].alias("len"), x["i"].alias("i"), x["surface"].alias("surface"))))
    clusters = F.transform(F.array_distinct(F.transform("_keyed", lambda k: k["key"])), lambda k: F.struct(k.alias("key"), ranked(k)["surface"].alias("surface")))

    def named(s: Column) -> Column:
        own = F.get(F.filter("_keyed", lambda k: k["start"] == s["start"]), F.lit(0))["key"]
        name = s["entity_type"] == "NAME"
        number = (F.array_position(F.transform("_clusters", lambda c: c["key"]), own) - 1).cast("string")
        best = F.get(F.filter("_clusters", lambda c: c["key"] == own), F.lit(0))["surface"]
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "entity_type", "text", "confidence", "source", "ord")], F.when(name, F.concat(F.lit("name_"), number)).alias("cluster_id"), F.when(name, best).alias("canonical"))

    # each step is a column: an array inside another's lambda would be made anew for every element
    for name, column in {"_names": names, "_whole": whole, "_keyed": keyed, "_clusters": clusters}.items():
        df = df.withColumn(name, column)
    return df.withColumn(into, F.transform(spans, named).cast(f"array<{ENTITY}>")).drop("_names", "_whole", "_keyed", "_clusters")
