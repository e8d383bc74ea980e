"""Approximate nearest neighbours by inner product: stable projections indexed by a kd-tree.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and a query gets a
zero there; the largest inner products are then the smallest distances. All points are projected
to a few dimensions by a Gaussian (2-stable) matrix. The top of a kd-tree over the projection, built from a
bounded sample, deals every row to a region. A query visits the regions in the order of their
distance in the projection, in rounds of growing size, and in a region the leaves of the tree below
it in the same order; it computes the exact inner products of their points. A chi-square test ends
a query, or its visit to a region: squared projected distance over squared true distance follows
chi-square with as many degrees as there are projected dimensions, so it tells how likely a point
that is still unseen is nearer than the k-th best found [Sun et al., SRS: Solving c-Approximate
Nearest Neighbor Queries in High Dimensional Euclidean Space with a Tiny Index, VLDB 2014].

Only queries that the test has not ended go to the next round. Queries meet regions through an
equi-join; a region of many rows is as many blocks.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, stored

LEAF = 64
MOST_REGIONS, MOST_LENGTHS = 4096, 1000
_ROUND = 8


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees."""
    half = np.asarray(x) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree by median splits along the widest side: the points' order, the leaves' first
    places in it (and the end), and the corners of their boxes."""
    order, todo, done = np.arange(len(points)), [(0, len(points))], []
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            done.append((a, b))
            continue
        part = points[order[a:b]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    done.sort()
    starts = np.array([a for a, _ in done] + [len(points)])
    low = np.array([points[order[a:b]].min(axis=0) for a, b in done])
    high = np.array([points[order[a:b]].max(axis=0) for a, b in done])
    return order, starts, low, high


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, dims: int, sure: float, seed: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the (ids, scores) of its k best of the block, padded with -inf, and the
    number of inner products computed. ``bound``: a k-th best score that each query already has."""
    norms = np.einsum("ij,ij->i", x, x)
    top = norms.max()
    matrix = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, dims))
    points = x @ matrix[:-1] + np.sqrt(top - norms)[:, None] * matrix[-1]
    order, starts, low, high = kd_leaves(points)
    x, ids = x[order], ids[order]
    n, leaves = len(q), len(starts) - 1
    pq = q @ matrix[:-1]
    gap = np.zeros((n, leaves))
    for j in range(dims):
        side = np.maximum(np.maximum(low[None, :, j] - pq[:, None, j], pq[:, None, j] - high[None, :, j]), 0)
        gap += side * side
    rank = np.argsort(gap, axis=1)
    gap = np.take_along_axis(gap, rank, axis=1)
    best = np.full((n, k), -np.inf)
    found = np.full((n, k), np.iinfo(np.int64).max)
    reach = np.einsum("ij,ij->i", q, q) + top
    bound = np.full(n, -np.inf) if bound is None else bound
    active, computed = np.arange(n), 0
    for t in range(0, leaves, _ROUND):
        wanted = rank[active, t : t + _ROUND]
        pairs = np.argsort(wanted, axis=None, kind="stable")
        of, leaf = active[pairs // wanted.shape[1]], wanted.ravel()[pairs]
        edges = np.r_[0, np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows, at = of[a:b], slice(starts[leaf[a]], starts[leaf[a] + 1])
            score = np.einsum("ij,kj->ik", q[rows], x[at])
            score[query_ids[rows][:, None] == ids[at][None, :]] = -np.inf
            computed += score.size
            better = np.flatnonzero((score >= best[rows, -1][:, None]).any(axis=1))
            if not len(better):
                continue
            rows, score = rows[better], score[better]
            all_scores = np.concatenate([best[rows], score], axis=1)
            all_ids = np.concatenate([found[rows], np.broadcast_to(ids[at], score.shape)], axis=1)
            all_ids = np.where(all_scores == -np.inf, np.iinfo(np.int64).max, all_ids)
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, pick, axis=1)
            found[rows] = np.take_along_axis(all_ids, pick, axis=1)
        if t + _ROUND >= leaves:
            break
        kth = np.maximum(reach[active] - 2 * np.maximum(best[active, -1], bound[active]), 1e-300)
        active = active[chi_square(gap[active, t + _ROUND] / kth, dims) < sure]
        if not len(active):
            break
    return found, best, computed


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor holding null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _packed(rows: DataFrame, keys: list[str], size: int, extra: int = 0) -> DataFrame:
    """Rows (keys, id, v) in matrices of up to ``size`` rows: keys, ids, data. Partitions are sorted by the keys,
    so a task holds a matrix, not its partition."""
    names = [*keys, "ids", "data"]
    rows = rows.sortWithinPartitions(*keys)

    def run(batches):
        held: dict[tuple, list] = {}

        def batch(key, parts):
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            return pa.record_batch([*(pa.array([x], pa.int32()) for x in key), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names)

        for b in batches:
            of = np.stack([b.column(c).to_numpy() for c in keys], axis=1)
            ids, v = b.column("id").to_numpy(), b.column("v")
            flat, offsets = v.values.to_numpy(), v.offsets.to_numpy()
            for key in np.unique(of, axis=0):
                at = np.flatnonzero((of == key).all(axis=1))
                dim = int(key[0]) + extra
                data = flat[(offsets[at][:, None] + np.arange(dim)).ravel()]
                parts = held.setdefault(tuple(key.tolist()), [])
                for s in range(0, len(at), size):
                    parts.append((ids[at[s : s + size]], data[s * dim : (s + size) * dim]))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield batch(tuple(key.tolist()), parts)
                        parts.clear()
            for key in [x for x in held if len(of) and x != tuple(of[-1].tolist())]:  # sorted: complete
                if parts := held.pop(key):
                    yield batch(key, parts)
        for key, parts in held.items():
            if parts:
                yield batch(key, parts)

    return rows.mapInArrow(run, ", ".join(f"{c} int" for c in keys) + ", ids binary, data binary")


def top_tree(points: np.ndarray, regions: int) -> list[tuple]:
    """A kd-tree with about that many leaves: nodes (axis, value, left, right), leaves (-1, number)."""
    tree: list[tuple] = []
    leaves = 0

    def grow(part, wanted):
        nonlocal leaves
        at = len(tree)
        tree.append(())
        if wanted > 1 and len(part):
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value = float(np.sort(part[:, axis])[len(part) * (wanted // 2) // wanted])
            low = part[:, axis] < value
            if low.any():
                left = grow(part[low], wanted // 2)
                tree[at] = (axis, value, left, grow(part[~low], wanted - wanted // 2))
                return at
        tree[at] = (-1, leaves)
        leaves += 1
        return at

    grow(points, regions)
    return tree


def route(tree: list[tuple], points: np.ndarray) -> np.ndarray:
    """The leaf that each point lies in."""
    out, todo = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if tree[node][0] < 0:
            out[at] = tree[node][1]
            continue
        axis, value, left, right = tree[node]
        low = points[at, axis] < value
        todo += [(left, at[low]), (right, at[~low])]
    return out


def _matrix(seed: int, dim: int, dims: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim + 1, dims))


def _each_length(batch: pa.RecordBatch):
    """(dim, rows, matrix of vectors) for each length of vectors in a batch."""
    of, v = batch.column("dim").to_numpy(), batch.column("v")
    flat, offsets = v.values.to_numpy(), v.offsets.to_numpy()
    for dim in np.unique(of).tolist():
        at = np.flatnonzero(of == dim)
        yield dim, at, flat[offsets[at][:, None] + np.arange(dim)]


def _placed(base: DataFrame, tops: dict[int, float], trees: dict | None, dims: int, seed: int) -> DataFrame:
    """Rows (id, v, dim, asked) with their projected point (p0 ..) and, given ``trees``, their region."""
    names = [f"p{i}" for i in range(dims)]

    def run(batches):
        for b in batches:
            points, region = np.zeros((len(b), dims)), np.zeros(len(b), dtype=np.int32)
            for dim, at, x in _each_length(b):
                matrix = _matrix(seed, dim, dims)
                rest = np.sqrt(np.maximum(0, tops[dim] - np.einsum("ij,ij->i", x, x)))
                points[at] = x @ matrix[:-1] + rest[:, None] * matrix[-1]
                if trees:
                    region[at] = route(trees[dim], points[at])
            yield pa.record_batch([*(b.column(c) for c in ("id", "v", "dim", "asked")), pa.array(region), *(pa.array(np.ascontiguousarray(points[:, i])) for i in range(dims))], ["id", "v", "dim", "asked", "region", *names])

    return base.mapInArrow(run, "id long, v array<double>, dim int, asked boolean, region int, " + ", ".join(f"{c} double" for c in names))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 6, sure: float = 0.9, region: int = 2048, sample: int = 20_000, first_round: int = 4, seed: int = 11, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects (a condition on the
    id), its ``k`` nearest other rows by inner product in double precision, ties to the smaller id.

    Rows with a null id or a vector that is not :func:`usable` take no part. Rows that share an id
    count as one, the one with the largest vector in array order. Vectors of different lengths
    are never compared; more than MOST_LENGTHS lengths are refused. Other columns are ignored; an empty table gives an empty result.

    The tree's top is built from ``sample`` rows of each length (those with the smallest hashes) and has a leaf for
    every ``region`` rows, MOST_REGIONS at most; every row is indexed. The driver holds the projected sample and the regions'
    boxes. ``report`` gets the numbers of inner products computed and of pairs of a query and a row.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base = cut(base.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v")).withColumn("asked", F.coalesce(is_query, F.lit(False))))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    lengths = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.sum(F.col("asked").cast("long")).alias("asked")).limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    tops = {r.dim: r.top for r in lengths}
    trees = {}
    for r in lengths:
        some = base.where(F.col("dim") == r.dim).orderBy(F.xxhash64("id"), "id").limit(sample)
        points = _placed(some, tops, None, dims, seed).select(*[f"p{i}" for i in range(dims)]).collect()
        trees[r.dim] = top_tree(np.array([tuple(p) for p in points]).reshape(-1, dims), max(1, min(MOST_REGIONS, r.n // region)))
    placed, _ = stored(_placed(base, tops, trees, dims, seed), "placed")
    sides = [f(f"p{i}") for i in range(dims) for f in (F.min, F.max)]
    found = placed.groupBy("dim", "region").agg(F.count(F.lit(1)), *sides).collect()
    boxes = {d: np.array([tuple(r)[1:] for r in found if r.dim == d]) for d in tops}  # region, rows, low and high by turns
    parts = spark.createDataFrame([(r[0], r[1], -(-r[2] // (2 * region))) for r in found], "dim int, region int, parts int")
    dealt = placed.join(F.broadcast(parts), ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks, _ = stored(_packed(dealt.repartition("dim", "region", "part").select("dim", "region", "id", "v"), ["dim", "region"], 2 * region), "blocks")
    shipped = spark.sparkContext.broadcast((boxes, tops))
    count = spark.sparkContext.accumulator(0)

    def visits(low: int, high: int):
        """The regions of each query's order from ``low`` to ``high``, unless the test ends it before."""

        def run(batches):
            boxes, tops = shipped.value
            for b in batches:
                kth = b.column("kth").to_numpy()
                for dim, at, q in _each_length(b):
                    box = boxes[dim]
                    point = q @ _matrix(seed, dim, dims)[:-1]
                    gap = np.zeros((len(at), len(box)))
                    for i in range(dims):
                        side = np.maximum(np.maximum(box[None, :, 2 + 2 * i] - point[:, None, i], point[:, None, i] - box[None, :, 3 + 2 * i]), 0)
                        gap += side * side
                    order = np.argsort(gap, axis=1, kind="stable")
                    if low >= len(box):
                        continue
                    gap = np.take_along_axis(gap, order, axis=1)
                    reach = np.maximum(np.einsum("ij,ij->i", q, q) + tops[dim] - 2 * kth[at], 1e-300)
                    go = np.flatnonzero(chi_square(gap[:, low] / reach, dims) < sure) if low else np.arange(len(at))
                    to = order[go, low:high]
                    rows = b.take(pa.array(np.repeat(at[go], to.shape[1])))
                    yield pa.record_batch([rows.column("dim"), pa.array(box[to.ravel(), 0].astype(np.int32)), *(rows.column(c) for c in ("id", "v", "kth"))], ["dim", "region", "id", "v", "kth"])

        return run

    def run(batches):
        for b in batches:
            for dim, ids, data, q_ids, q_data in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "data", "q_ids", "q_data")), strict=True):
                x, q = (np.frombuffer(d, dtype=np.float64).reshape(-1, n) for d, n in ((data, dim), (q_data, dim + 1)))
                bound, q = q[:, -1], np.ascontiguousarray(q[:, :-1])
                q_ids = np.frombuffer(q_ids, dtype=np.int64)
                near, best, computed = search(np.frombuffer(ids, dtype=np.int64), x, q_ids, q, k, dims, sure, seed, bound)
                count.add(computed)
                real = (best > -np.inf) & (best >= bound[:, None])
                yield pa.record_batch([pa.array(np.repeat(q_ids, real.sum(axis=1))), pa.array(near[real]), pa.array(best[real])], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    asked = placed.where("asked").select("dim", "id", "v").withColumn("kth", F.lit(float("-inf")))
    best, low, high = None, 0, first_round
    most = max((len(b) for b in boxes.values()), default=0)
    while low < most:
        goes = cut(asked.mapInArrow(visits(low, high), "dim int, region int, id long, v array<double>, kth double"))
        if goes.isEmpty():
            break
        # the bound travels as one more component
        packed = goes.select("dim", "region", "id", F.concat("v", F.array("kth")).alias("v"))
        packed = _packed(packed.repartition("dim", "region"), ["dim", "region"], 1024, extra=1)
        met = packed.select("dim", "region", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).join(blocks, ["dim", "region"])
        hits = met.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, "query_id long, vec_id long, score double")
        hits = hits if best is None else hits.union(best.select("query_id", "vec_id", "score"))
        best = cut(hits.withColumn("rank", rank).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("now"))
        left = goes.select("id").distinct()
        asked = placed.where("asked").select("dim", "id", "v").join(left, "id", "left_semi").join(kth, "id", "left")
        asked = asked.select("dim", "id", "v", F.coalesce("now", F.lit(float("-inf"))).alias("kth"))
        low, high = high, 3 * high
    pairs = sum(r.n * r.asked for r in lengths)
    if report is not None:
        report.update(computed=count.value, pairs=pairs)
    logging.getLogger(__name__).info("%d inner products for %d pairs", count.value, pairs)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
