"""Language identification as multilingual mixture inference.

Each language is a distribution of letter trigrams, counted over all training documents. A
document is a mixture: expectation-maximisation estimates its languages' proportions from the
trigrams' likelihoods, with a uniform component for text in no learned language, until no
proportion moves by TOLERANCE (or after MOST_STEPS). Nested sets of the languages with the largest
proportions, down to LEAST_SHARE, are then fitted and compared by their likelihood with a penalty
for each language (BIC); the prediction is the most probable language of the chosen set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

BUCKETS = 1 << 16
UNKNOWN = "und"
TOLERANCE, MOST_STEPS = 1e-3, 200
LEAST_SHARE = 0.01
MOST_LANGUAGES = 256
_FEATURES = 400_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the code point of its lower-case form, 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x32000):  # planes with letters
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def trigrams(text: str) -> np.ndarray:
    """Hashes below BUCKETS of the letter trigrams; runs of other characters count as one gap."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = _letters()[points]
    low = np.r_[np.uint32(0), low[(low != 0) | np.r_[False, low[:-1] != 0]], np.uint32(0)] if len(low) else low
    if not low.any():
        return np.empty(0, dtype=np.int64)
    h = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)[low[1:-1] != 0]


def count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang)."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                counts = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                grams = trigrams(text.as_py())
                if len(grams) > BUCKETS // 8:
                    counts += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(counts, grams, 1)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages in alphabetical order and their probabilities of each bucket, a row per bucket, the uniform
    component last. The table has BUCKETS rows whatever the corpus holds; more than MOST_LANGUAGES
    languages are refused, so what reaches the driver and the tasks is bounded."""
    named = docs.where("lang is not null").select("lang").distinct()
    if named.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = count(docs).toPandas()
    langs = sorted(set(counts["lang"]))
    table = np.zeros((BUCKETS, len(langs) + 1))
    table[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)}).astype(int)] = counts["n"]
    table += smoothing
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def mixture(p: np.ndarray, n: np.ndarray, sizes: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Proportions by expectation-maximisation from ``pi`` for many documents at once. p: the features'
    probabilities; n: their counts; sizes: how many of them are each document's. Documents that
    have settled are put aside."""
    out, rows = pi.copy(), np.arange(len(pi))
    for _ in range(MOST_STEPS):
        starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        total = np.add.reduceat(n, starts)[:, None]
        while True:
            share = p * pi[of]
            share *= (n / share.sum(axis=1))[:, None]
            new = np.add.reduceat(share, starts, axis=0) / total
            moving = np.abs(new - pi).max(axis=1) >= TOLERANCE
            pi = new
            if 2 * np.count_nonzero(moving) <= len(moving):
                break
        out[rows] = pi
        if not moving.any():
            break
        left = np.repeat(moving, sizes)
        p, n, sizes, pi, rows = p[left], n[left], sizes[moving], pi[moving], rows[moving]
    return out


def infer(docs: list[np.ndarray], table: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents with at least one trigram: the proportions of the languages of the chosen set, a
    row per document that adds up to one, and the proportion of text in none of the languages."""
    counted = [np.unique(d, return_counts=True) for d in docs]
    f = np.concatenate([c[0] for c in counted])
    n = np.concatenate([c[1] for c in counted]).astype(np.float32)
    sizes = np.array([len(c[0]) for c in counted])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)
    p = table[f]
    k = p.shape[1]
    pi = mixture(p, n, sizes, np.full((len(docs), k), 1 / k, dtype=np.float32))
    known = pi[:, :languages]
    share = known / np.maximum(known.sum(axis=1, keepdims=True), 1e-30)
    order = np.argsort(-share, axis=1, kind="stable")
    every = np.arange(len(docs))
    # penalised likelihood of the sets {1st}, {1st, 2nd}, ...: a further language must pay for itself
    total = np.add.reduceat(n, starts)
    chosen = np.zeros((len(docs), languages), dtype=np.float32)
    chosen[every, order[:, 0]] = 1
    score = np.add.reduceat(n * np.log(p[np.arange(len(f)), order[of, 0]]), starts)
    for size in range(2, languages + 1):
        more = np.flatnonzero(share[every, order[:, size - 1]] > LEAST_SHARE)
        if not len(more):
            break
        trial = np.zeros((len(more), languages), dtype=bool)
        np.put_along_axis(trial, order[more, :size], True, axis=1)
        at = np.flatnonzero(np.repeat(np.isin(every, more), sizes))
        inner = np.cumsum(sizes[more]) - sizes[more]
        start = np.where(trial, share[more] + 1e-3, 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        fit = mixture(p[at, :languages], n[at], sizes[more], start)
        mixed = (p[at, :languages] * np.repeat(fit, sizes[more], axis=0)).sum(axis=1)
        like = np.add.reduceat(n[at] * np.log(np.maximum(mixed, 1e-30)), inner)
        like -= 0.5 * (size - 1) * np.log(total[more])
        won = like > score[more]
        score[more[won]], chosen[more[won]] = like[won], fit[won]
    return chosen, pi[:, languages:].sum(axis=1)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred, score (the proportion of the text in lang_pred),
    foreign (the proportion of text in no learned language) and languages (the chosen set, with each
    language's proportion among them, the largest first).

    The text alone is looked at. A null text, one without letters, or a model without languages:
    ``und``, score 0, foreign 1, no languages.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    pair = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for b in batches:
            pred, score, foreign, sets = [UNKNOWN] * len(b), np.zeros(len(b)), np.ones(len(b)), [[] for _ in range(len(b))]
            held, size = [], 0

            def flush():
                chosen, none = infer([g for _, g in held], shipped.value, len(langs))
                for (i, _), row, u in zip(held, chosen, none.tolist(), strict=True):  # noqa: B023
                    found = sorted(((float(row[x]), langs[x]) for x in np.flatnonzero(row)), key=lambda x: (-x[0], x[1]))
                    sets[i] = [{"lang": x, "share": s} for s, x in found]  # noqa: B023
                    foreign[i] = min(1.0, max(0.0, u))  # noqa: B023
                    pred[i], score[i] = found[0][1], min(1.0, found[0][0]) * (1 - foreign[i])  # noqa: B023

            for i, t in enumerate(b.column("text")):
                grams = trigrams(t.as_py() or "") if langs else ()
                if len(grams):
                    held.append((i, grams))
                    size += len(grams)
                if size > _FEATURES:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score), pa.array(foreign), pa.array(sets, pair)], [*keep, *_TOLD])

    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    kept = [x for x in rows.schema if x.name in keep]
    told = T.StructType(kept).add("lang_pred", "string").add("score", "double").add("foreign", "double")
    return rows.mapInArrow(run, told.add("languages", T.ArrayType(T.StructType().add("lang", "string").add("share", "double"))))


_TOLD = ("lang_pred", "score", "foreign", "languages")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is, for its larger part, in a learned language: texts that are
    null or without letters go, and those with a foreign proportion over a half."""
    langs, table = model(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    own = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in _TOLD}  # names that clash
    rows = docs.withColumnsRenamed(own)
    out = predict(rows, langs, table, rows.columns)
    kept = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("foreign") <= 0.5)).drop(*_TOLD)
    return kept.withColumnsRenamed({b: a for a, b in own.items()})


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, foreign, languages) of every row of ``docs`` (doc_id, text, lang): learned from the rows
    that are not held out and have an id, a text and a language; predicted for all rows from their
    text alone. Repeated rows are learned from and predicted each; other columns are ignored."""
    langs, table = model(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    out = predict(docs, langs, table, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *_TOLD)
