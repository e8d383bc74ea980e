"""What several operators share: the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing in a local session, a temporary folder is made once and set as the
    checkpoint folder; on one machine that folder is shared by nature. On a cluster the setting
    must be there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not folder and not current.isDefined() and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="veilspark-")
    if not current.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read from there, and the table's path."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the length of texts: Arrow batches of at
    most 10,000 rows and 4 MB. To be called by whoever owns the session, before a query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: no later job computes it again, and
    a lost executor loses nothing. The files stay until the folder is cleared, unless the session was
    made with spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def likely(df: DataFrame, key: str, ids: DataFrame, into: str, bits: int = 1 << 24) -> DataFrame:
    """``df`` with the column ``into``: whether the column ``key`` may be among the values of the one
    column of ``ids``. True for all that are, false for most that are not, and for nulls.

    The values' hashes set bits of a map; at most ``bits`` / 64 rows of it are broadcast, however many
    values there are. So a join that concerns few rows of a large table need not move the others.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = ids.select(bit(F.col(ids.columns[0])).alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, CAST(_bit % 64 AS INT)))").alias("_marks"))
    word, marked = (fresh(df, x) for x in ("_word", "_marks"))
    marks = marks.select(F.col("_word").alias(word), F.col("_marks").alias(marked))
    joined = df.withColumn(word, F.floor(bit(F.col(key)) / 64)).join(F.broadcast(marks), word, "left")
    own = F.call_function("shiftright", F.col(marked), (bit(F.col(key)) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(into, F.col(key).isNotNull() & F.coalesce(own, F.lit(False))).drop(word, marked)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order: list[str], into: str, of: str | None = None, per_bucket: int = 50_000, most: int = 1 << 14) -> tuple[DataFrame, dict]:
    """Gapless row numbers from 0, per value of the integer column ``of`` (None: over all rows).

    No task sees more than a bucket's rows: the rows of a value are dealt to buckets of about
    ``per_bucket`` rows (``most`` buckets at most) by the hash of ``order``, ranked in their
    bucket, and shifted by the count of all earlier buckets. Those counts, at most ``most`` for
    each value of ``of``, whose values are few by contract, are all that reaches the driver. The
    number depends on the rows' values alone, not on how files or partitions hold them; rows equal
    in all of ``order`` are interchangeable.

    ``df`` is read three times: pass a table or a checkpoint. Returns the numbered rows and the
    row count of each value of ``of`` (under None, if that is None).
    """
    spark = df.sparkSession
    by = [of] if of else []
    number, bucket, rank, shift = (fresh(df, x) for x in ("_number", "_bucket", "_rank", "_shift"))
    if of:
        kind = dict(df.dtypes)[of]
        totals = {r[of]: r["count"] for r in df.groupBy(of).count().collect()}
        buckets = spark.createDataFrame([(k, min(most, -(-n // per_bucket))) for k, n in totals.items()], f"{of} {kind}, {number} int")
        rows, modulus = df.join(F.broadcast(buckets), of), F.col(number)
    else:
        totals = {None: df.count()}
        rows, modulus = df.withColumn(number, F.lit(0)), F.lit(max(1, min(most, -(-totals[None] // per_bucket))))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(17), *order), modulus).cast("int")).drop(number)
    shifts, at = [], dict.fromkeys(totals, 0)
    for r in sorted(dealt.groupBy(*by, bucket).count().collect(), key=lambda r: tuple(r)[:-1]):
        value = r[of] if of else None
        shifts.append((*([value] if of else []), r[bucket], at[value]))
        at[value] += r["count"]
    table = spark.createDataFrame(shifts, (f"{of} {kind}, " if of else "") + f"{bucket} int, {shift} long")
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1)
    out = ranked.join(F.broadcast(table), [*by, bucket]).withColumn(into, F.col(rank) + F.col(shift))
    return out.drop(bucket, rank, shift), totals


def spanning(edges: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Some of the edges (a, b) that connect what all of them do: of every ``at_once`` or so, those that
    close no circle. ``edges`` is read twice: pass a table or a checkpoint."""
    parts = max(1, -(-edges.count() // at_once))

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    keep[i] = True
            yield b.filter(pa.array(keep))

    return edges.select("a", "b").coalesce(parts).mapInArrow(run, "a long, b long")


def groups(edges: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """The rows of :func:`components` and one of each root itself (root, root); up to ``at_once`` edges are solved by one task, that holds no more than their
    ends. ``edges`` is read twice: pass a table or a checkpoint."""
    if edges.count() > at_once:
        parts = cut(components(spanning(edges, at_once)))
        return parts.union(parts.select("root", "root").distinct())

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        nodes = [x for x in root if find(x) != x]
        nodes += {find(x) for x in nodes}
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the graph with the edges (a, b): one row (node, root) for each node
    that has an edge to another one, but for the roots; root is the component's smallest node.

    Alternating large-star and small-star steps [Kiveris et al., Connected Components in
    MapReduce and Beyond, 2014]. Each step is an aggregate with partial sums and an equi-join, so
    a node with very many neighbours is split like any skewed key. Every round is checkpointed;
    only its row count and checksum reach the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large has u > v throughout: v is the smallest node next to a node below u
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(small.select("p.u", "p.v").where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
