"""Quality classification by hierarchical empirical Bayes.

Three levels of evidence meet in a document's log-odds. A logistic classifier over the words and
the shape of the whole text gives the document's own likelihood ratio. All rows give, by grouped
aggregation, success counts of their host and of their path on it: a label counts one, an
unlabelled row counts a part of its classifier probability. Beta-binomial shrinkage draws sparse
hosts toward the global rate and sparse paths toward their host's, as strongly as the
between-site variance of the data itself implies. The posterior of the path is the prior of its
documents.

The classifier alone is fitted on a bounded sample of labelled rows (``sample``, taken by hash);
site counts, rates and shrinkage cover all rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import plain_words

WORDS = 1 << 18
_BINS = 16
_SHAPES = 8
FEATURES = WORDS + _SHAPES * _BINS
#: The targets: a name, and what a label row says about it (null: nothing).
TARGETS = ("low", "toxic")


def features(text: bytes) -> np.ndarray:
    """Ids of the words, their beginnings of 4 and 5 bytes (all hashed) and the shape classes that a
    text has, each once, sorted. Beginnings stand for inflected words."""
    raw = text.split()
    words = set(plain_words(text))
    ids = {zlib.crc32(w) % WORDS for w in words}
    for k in (4, 5):
        ids.update(zlib.crc32(w, k) % WORDS for w in {w[:k] for w in words if len(w) > k})
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = max(1, len(text))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        counts[65:91].sum() / letters,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
        counts[48:58].sum() / n,
        1 - len(set(raw)) / max(1, len(raw)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / max(1, len(raw)),
    )
    shape = [min(_BINS - 1, int(_BINS * np.sqrt(s))) for s in shares]
    shape += [min(_BINS - 1, len(raw).bit_length()), min(_BINS - 1, (len(text) // max(1, len(raw))))]
    ids.update(WORDS + k * _BINS + b for k, b in enumerate(shape))
    return np.sort(np.fromiter(ids, dtype=np.int64, count=len(ids)))


def _labels(labels: DataFrame) -> DataFrame:
    """(_label_id, low, toxic) for each labelled document; of several labels the worse counts."""
    low = F.when(F.col("quality").isNotNull(), F.when(F.col("quality") > 0, 0).otherwise(1))
    toxic = F.when(F.col("toxic").isNotNull(), F.when(F.col("toxic") > 0, 1).otherwise(0))
    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_label_id"), low.alias("low"), toxic.alias("toxic"))
    return rows.groupBy("_label_id").agg(*[F.max(t).alias(t) for t in TARGETS])


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, n_low, pos_low, n_toxic, pos_toxic): labelled rows that have a feature."""

    def run(batches):
        held = np.zeros((FEATURES, 4), dtype=np.int64)
        for b in batches:
            for text, *labels in zip(b.column("text").cast(pa.binary()), *(b.column(t).to_pylist() for t in TARGETS), strict=True):
                add = [x for y in labels for x in (y is not None, bool(y))]
                held[features(text.as_py() or b"")] += np.array(add, dtype=np.int64)
        at = np.flatnonzero(held.any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(held[at, i]) for i in range(4))], ["feature", "a", "b", "c", "d"])

    sums = rows.mapInArrow(run, "feature long, a long, b long, c long, d long").groupBy("feature")
    return sums.agg(*[F.sum(x).alias(x) for x in "abcd"])


def chosen(feature: np.ndarray, n: np.ndarray, pos: np.ndarray, total: int, total_pos: int, most: int) -> np.ndarray:
    """The features with the largest chi-square against the target, if over 12 and in 5 rows."""
    rate = total_pos / max(1, total)
    spread = rate * (1 - rate)
    if spread <= 0:
        return np.empty(0, dtype=np.int64)
    part = n * (1 - n / max(1, total))
    chi = (pos - n * rate) ** 2 / (spread * np.maximum(part, 1e-9))
    ok = np.flatnonzero((chi > 12) & (n >= 5) & (part >= 1))
    ok = ok[np.lexsort((feature[ok], -chi[ok]))][:most]
    return np.sort(feature[ok])


def fit(rows: list[np.ndarray], y: np.ndarray, ids: np.ndarray, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """Ridge logistic regression of y on the presence of the features ``ids``, by accelerated
    gradient steps: weights, intercept, and the log-odds of the target's rate in the sample."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(rate / (1 - rate)))
    if not len(ids):
        return np.zeros(0), prior, prior
    at = [np.searchsorted(ids, r[np.isin(r, ids)]) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    col = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
    k = len(ids)
    w, b, vw, vb = np.zeros(k), prior, np.zeros(k), prior
    longest = max((len(a) for a in at), default=1) + 1
    # Newton-like scale of each weight: a feature's rows bound its curvature
    scale = 4 / (np.bincount(col, minlength=k) * min(longest, 12) + 4 * ridge)
    bias_scale = 4 / (len(y) * min(longest, 12))
    before_w, before_b = w, b
    for step in range(steps):
        z = vb + np.bincount(of, vw[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w, b = vw - scale * (np.bincount(col, error[of], k) + ridge * vw), vb - bias_scale * error.sum()
        momentum = step / (step + 3)
        vw, vb = w + momentum * (w - before_w), b + momentum * (b - before_b)
        before_w, before_b = w, b
    return w, float(b), prior


def train(docs: DataFrame, labels: DataFrame, sample: int = 40_000, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights (FEATURES x targets) and offsets such that a document's offset and weights add up to its log likelihood ratio of each
    target. Fitted on at most ``sample`` labelled documents, those with the smallest hashes."""
    some = labels.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    # the sample is bounded by its parameter
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(some)), F.col("doc_id") == F.col("_label_id"))
    rows = cut(rows.select("doc_id", "text", *TARGETS))  # the sample is read from here on
    table = np.array([tuple(r) for r in _counts(rows).collect()], dtype=np.int64).reshape(-1, 5)
    table = table[np.argsort(table[:, 0])]
    totals = rows.agg(*[f(t) for t in TARGETS for f in (F.count, F.sum)]).first()
    picked = [chosen(table[:, 0], table[:, 1 + 2 * i], table[:, 2 + 2 * i], totals[2 * i], totals[2 * i + 1] or 0, most) for i in range(2)]
    every = np.union1d(*picked)

    def run(batches):
        for b in batches:
            ids = [features(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            kept = [x[np.isin(x, every, assume_unique=True)].astype("<i4").tobytes() for x in ids]
            yield pa.record_batch([pa.array(kept, pa.binary()), *(b.column(t) for t in TARGETS)], ["ids", *TARGETS])

    seen = rows.mapInArrow(run, "ids binary, low int, toxic int").collect()
    weights, offsets = np.zeros((FEATURES, len(TARGETS)), dtype=np.float32), np.zeros(len(TARGETS))
    for i, t in enumerate(TARGETS):
        own = [r for r in seen if r[t] is not None]
        if own:
            w, b, prior = fit([np.frombuffer(r.ids, "<i4").astype(np.int64) for r in own], np.array([r[t] for r in own], dtype=float), picked[i])
            weights[picked[i], i], offsets[i] = w, b - prior
    return weights, offsets


def evidence(docs: DataFrame, weights: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """(doc_id, host, path, llr_low, llr_toxic) of every row: the classifier's log likelihood
    ratios from the whole text. A null text has none: zero."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            w, out = shipped.value, np.zeros((len(b), len(TARGETS)))
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                if text.is_valid:
                    out[i] = offsets + w[features(text.as_py())].sum(axis=0, dtype=np.float64)
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "host", "path")), *(pa.array(out[:, i]) for i in range(len(TARGETS)))], ["doc_id", "host", "path", *(f"llr_{t}" for t in TARGETS)])

    return docs.mapInArrow(run, f"doc_id {kinds['doc_id']}, host string, path string, " + ", ".join(f"llr_{t} double" for t in TARGETS))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def concentration(groups: DataFrame, n: str, k: str, within: tuple[str, ...] = ()) -> float:
    """How many rows the common prior of the groups is worth: the beta-binomial concentration implied by
    the intraclass correlation (analysis of variance on the counts). With ``within``, groups are
    compared with the mean of those that share these columns, not with the mean of all."""
    some = groups.where(F.col(n) > 0)
    sums = [F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(k) * F.col(k) / F.col(n)).alias("kk")]
    each = some.groupBy(*within).agg(*sums).where("n > 0")
    s = each.agg(F.sum("g"), F.count(F.lit(1)), F.sum("n"), F.sum("k"), F.sum("kk"), F.sum(F.col("k") * F.col("k") / F.col("n")), F.sum(F.col("nn") / F.col("n"))).first()
    number, parents, total, hits, ratio, means, squares = (float(x or 0) for x in s)
    if number <= parents or total <= number:
        return 100.0
    between = max(0.0, ratio - means) / (number - parents)
    inside = max(0.0, hits - ratio) / (total - number)
    size = (total - squares) / (number - parents)
    bottom = between + (size - 1) * inside
    if bottom <= 0 or between <= inside:
        return 1e6
    rho = (between - inside) / bottom
    return min(1e6, max(1.0, (1 - rho) / rho))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 40_000, soft: float = 0.25) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and what ``host`` and ``path`` need): doc_id,
    quality (posterior probability of good quality), toxic (that of being toxic), host_quality and
    path_quality (the sites' posterior means), host_toxic, path_toxic, keep (quality of at
    least a half and toxic below).

    ``labels``: doc_id, quality, toxic; a null says nothing. A null host or path is a site of its own;
    a path is one of its host. Null texts have only their sites' evidence. Without labels every
    rate is a half and every row is kept. Repeated rows of ``docs`` are rows each; of several labels
    of a document the worse counts. Extra columns are ignored.

    A row's prior is that of its path without the row's own label or guess, so nothing is counted
    twice; only the global rate holds all rows. The classifier is fitted on at most ``sample``
    labelled rows, on the 1000 features of each target with the largest chi-square over 12 that
    occur in five rows at least; ``soft`` is what an unlabelled row's guess is worth in counts.
    """
    known = cut(_labels(labels))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    rows = docs.select("doc_id", "text", key(host).alias("host"), key(path).alias("path"))
    seen = cut(evidence(rows, *train(docs, known, sample)))
    rates = known.agg(*[f(t) for t in TARGETS for f in (F.count, F.sum)]).first()
    prior = {t: (float(rates[2 * i + 1] or 0) + 0.5) / (rates[2 * i] + 1) for i, t in enumerate(TARGETS)}
    told = seen.join(known, seen["doc_id"].cast("long") == known["_label_id"], "left")
    for t in TARGETS:
        guess = _sigmoid(F.col(f"llr_{t}") + float(np.log(prior[t] / (1 - prior[t]))))
        told = told.withColumn(f"n_{t}", F.when(F.col(t).isNotNull(), 1.0).otherwise(soft if rates[2 * TARGETS.index(t)] else 0.0))
        told = told.withColumn(f"k_{t}", F.coalesce(F.col(t).cast("double"), guess * F.col(f"n_{t}")))
    sums = [F.sum(f"{x}_{t}").alias(f"{x}_{t}") for t in TARGETS for x in "nk"]
    paths = cut(told.groupBy("host", "path").agg(*sums))
    hosts = cut(paths.groupBy("host").agg(*sums))
    whole = hosts.agg(*sums).first()
    site = paths.join(hosts.select("host", *[F.col(f"{x}_{t}").alias(f"host_{x}_{t}") for t in TARGETS for x in "nk"]), "host")
    site = site.withColumnsRenamed({f"{x}_{t}": f"path_{x}_{t}" for t in TARGETS for x in "nk"})
    out = told.join(site, ["host", "path"])
    for t in TARGETS:
        base = (float(whole[f"k_{t}"] or 0) + 0.5) / (float(whole[f"n_{t}"] or 0) + 1)
        a, b = concentration(hosts, f"n_{t}", f"k_{t}"), concentration(paths, f"n_{t}", f"k_{t}", ("host",))

        def rates_of(n, k):
            """The posterior means of host and path without n rows of which k are hits."""
            host = (F.greatest(F.col(f"host_k_{t}") - k, F.lit(0.0)) + a * base) / (F.greatest(F.col(f"host_n_{t}") - n, F.lit(0.0)) + a)  # noqa: B023
            return host, (F.greatest(F.col(f"path_k_{t}") - k, F.lit(0.0)) + b * host) / (F.greatest(F.col(f"path_n_{t}") - n, F.lit(0.0)) + b)  # noqa: B023

        host_rate, rate = rates_of(F.lit(0.0), F.lit(0.0))
        prior_rate = rates_of(F.col(f"n_{t}"), F.col(f"k_{t}"))[1]
        out = out.withColumn(f"host_rate_{t}", host_rate).withColumn(f"rate_{t}", rate)
        out = out.withColumn(f"posterior_{t}", _sigmoid(F.col(f"llr_{t}") + _logit(prior_rate)))
    return out.select(
        "doc_id",
        (1 - F.col("posterior_low")).alias("quality"),
        F.col("posterior_toxic").alias("toxic"),
        (1 - F.col("host_rate_low")).alias("host_quality"),
        (1 - F.col("rate_low")).alias("path_quality"),
        F.col("host_rate_toxic").alias("host_toxic"),
        F.col("rate_toxic").alias("path_toxic"),
        ((F.col("posterior_low") <= 0.5) & ((F.col("posterior_toxic") < 0.5) | F.lit(not rates[2]))).alias("keep"),
    )
