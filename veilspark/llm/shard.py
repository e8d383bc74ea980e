"""Reproducible shuffle into shards: a Feistel permutation of the global row numbers.

Law ``rows``: row number g goes to place p = permutation(g) of 0 .. N-1, shard p mod S and slot
p div S. Shards differ by one row at most, slots are gapless, and both directions are computable
from N, S and the key alone: :func:`place` and :func:`row_at`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, numbered

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of two multiply-xorshift steps."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * 1000003 + r], dtype=np.uint64), 0x51ED27)[0]) for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & low), left
        else:
            left, right = right, left ^ (_mix(right, k) & low)
    return left << np.uint64(bits) | right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (or its inverse) at ``x``. The Feistel network works on the
    next power of four; a value that falls outside is sent through again until it lies inside,
    which takes fewer than four rounds on average and always ends, as cycles do."""
    x = np.asarray(x, dtype=np.uint64)
    if n <= 1:
        return x.copy()
    bits, keys = _half_bits(n), _keys(seed)
    out = _once(x, bits, keys, back)
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = _once(out[outside], bits, keys, back)
    return out


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(row, n, seed)
    return (p % np.uint64(shards)).astype(np.int64), (p // np.uint64(shards)).astype(np.int64)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Global row numbers at (shard, slot): the inverse of :func:`place`."""
    p = np.asarray(slot, dtype=np.uint64) * np.uint64(shards) + np.asarray(shard, dtype=np.uint64)
    return permute(p, n, seed, back=True).astype(np.int64)


def shard(rows: DataFrame, order: list[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """``rows`` with the columns row (global number), shard and slot.

    The row number follows the hash of the columns ``order``: the same rows get the same places in
    whatever files they come. Rows equal in all of ``order`` share a bucket and are
    interchangeable. Nulls count as values; an empty table gives an empty result. ``rows`` is read
    three times: pass a table or a checkpoint. Clashing columns row, shard and slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = rows.drop("row", "shard", "slot")
    out, totals = numbered(rows, order, "row")
    n, pair = totals[None], fresh(rows, "_place")

    @F.pandas_udf("shard int, slot long")
    def placed(row: pd.Series) -> pd.DataFrame:
        s, t = place(row.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": s.astype(np.int32), "slot": t})

    return out.withColumn(pair, placed("row")).select("*", f"{pair}.shard", f"{pair}.slot").drop(pair)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Documents (doc_id, text) dealt by :func:`shard`, as doc_id, size (UTF-8 bytes of the text, null:
    none, plus 8), text_crc32 (0 for a null text, as for an empty one), law, shard, slot,
    grown_shard (null: only the law ``key`` has one), group (the hash that equal texts share; the law deals rows,
    so a group's rows lie in any shard). The text itself is read once and never shuffled."""
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    dealt = shard(cut(digest), ["doc_id", "text_hash", "size", "text_crc32"], shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("text_hash").alias("group"))
