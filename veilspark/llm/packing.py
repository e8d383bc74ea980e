"""Best-fit packing of documents into token sequences, by bin completion branch-and-bound.

Lengths are whole numbers up to the capacity, so the packing problem of any number of pieces is a
histogram of at most ``capacity`` counts. It is solved there: a best-fit-decreasing solution is
the first incumbent; branch-and-bound then completes one bin after another around the largest
piece left, with undominated fillings, and prunes by the waste that a better solution may have.
The solution is a list of patterns (lengths in a bin) with multiplicities; pieces take their
places in it by their rank among the pieces of equal length.
"""

from __future__ import annotations

import json
import logging
import zlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, numbered

END_ID = 2


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to its ids under the tokenizer file at ``path``, as the library gives them
    without adding special tokens: the strings of special tokens in a text become those tokens.
    Byte-level BPE files whose merges are in the order of their ids run as a rank table, which gives
    the same ids in a sixth of the time; texts with such strings go through the library."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library: list = []

    def slow(text: str) -> np.ndarray:
        if not library:
            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    table = _ranks(spec)
    if table is None:
        return slow
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def fast(text: str) -> np.ndarray:
        if any(x in text for x in added):
            return slow(text)
        return np.asarray(coder.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return fast


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes by id, if it is byte-level BPE with ids in the order of merges."""
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocabulary) != 256 + len(pairs):
        return None
    return {bytes(back[c] for c in t): i for t, i in vocabulary.items()}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one, or a shorter first one and full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's text and its end id. A null
    text counts as an empty one: a piece that is the end id alone."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            out: list = [[], [], [], [], [], []]
            rows = []
            for at, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start : start + n].tobytes()
                    rows.append(at)
                    for column, value in zip(out, (k, start, n, zlib.crc32(data), data if keep_ids else None), strict=False):
                        column.append(value)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the packing problem on a histogram of lengths -----------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    sizes = np.arange(capacity + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(weight[-1]) // capacity)
    for a in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - a])
        half_n = int(number[capacity - a] - number[capacity // 2])
        half_w = int(weight[capacity - a] - weight[capacity // 2])
        small_w = int(weight[capacity // 2] - (weight[a - 1] if a else 0))
        best = max(best, large + half_n + max(0, -(-(small_w - (half_n * capacity - half_w)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: patterns with multiplicities. Bins of equal content move as one."""
    bins: list[list] = [[] for _ in range(capacity + 1)]  # by room left: [pattern, number]
    for s in range(capacity, 0, -1):
        n, room = int(counts[s]), s
        while n and room <= capacity:
            if not bins[room]:
                room += 1
                continue
            pattern, k = bins[room].pop()
            used = min(n, k)
            if used < k:
                bins[room].append((pattern, k - used))
            bins[room - s].append(((*pattern, s), used))
            n -= used
            room = max(s, room - s) if room - s >= s else room
        each = capacity // s
        if n >= each:
            bins[capacity - each * s].append(((s,) * each, n // each))
        if n % each:
            bins[capacity - n % each * s].append(((s,) * (n % each), 1))
    return [(p, k) for left in bins for p, k in left]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit into bins as large as the pieces of ``a``."""
    if sum(a) < sum(b) or len(b) > 4 or a == b:
        return False
    for order in permutations(b):
        room = list(a)
        for x in order:
            i = next((i for i, y in enumerate(room) if y >= x), None)
            if i is None:
                break
            room[i] -= x
        else:
            return True
    return False


def fillings(counts: np.ndarray, room: int, waste: int, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that leave at most ``waste``, the least waste first: up to
    ``limit`` of them, in the order of a depth-first search from the largest lengths."""
    have = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    found: list[tuple[int, ...]] = []
    left = {s: int(counts[s]) for s in have}
    steps = 0

    def search(first: int, space: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        fits = [i for i in range(first, len(have)) if have[i] <= space and left[have[i]] > 0]
        if not fits:
            if space <= waste:
                found.append(chosen)
            return
        for i in fits:
            if len(found) >= limit or steps > 40 * limit:
                return
            s = have[i]
            left[s] -= 1
            search(i, space - s, (*chosen, s))
            left[s] += 1
            if s == space or space - s < have[-1]:  # the largest last piece dominates smaller ones
                break

    search(0, room, ())
    found = sorted(set(found), key=lambda f: (-sum(f), len(f)))
    return [f for i, f in enumerate(found) if not any(_dominates(g, f) for g in found[:i])] if len(found) <= 64 else found


def solve(counts: np.ndarray, capacity: int, nodes: int = 4000, limit: int = 24) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns with multiplicities that use up ``counts`` (index: length), and a lower bound of
    the number of bins. The search ends when the bound is met or after ``nodes`` nodes; the best
    solution found is returned, at worst that of best fit."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(k for _, k in incumbent)
    total = int((counts * np.arange(capacity + 1)).sum())
    budget = nodes

    def children(state: np.ndarray, waste: int):
        largest = int(np.flatnonzero(state)[-1])
        state[largest] -= 1
        options = fillings(state, capacity - largest, waste, limit)
        state[largest] += 1
        return [(largest, *f) for f in options]

    state, used, lost, chosen = counts.copy(), 0, 0, []
    allowance = (best - 1) * capacity - total
    stack = [iter(children(state, allowance))] if total and best > bound else []
    while stack and budget and best > bound:
        pattern = next(stack[-1], None)
        if pattern is None:
            stack.pop()
            if chosen:
                last, k = chosen.pop()
                for s in last:
                    state[s] += k
                used, lost = used - k, lost - k * (capacity - sum(last))
            continue
        budget -= 1
        kinds, number = np.unique(pattern, return_counts=True)
        k = int((state[kinds] // number).min())
        waste = capacity - sum(pattern)
        allowance = (best - 1) * capacity - total - lost
        if waste:
            k = min(k, allowance // waste)
        if not k:
            continue  # more waste than any better solution has
        state[kinds] -= k * number
        used, lost = used + k, lost + k * waste
        chosen.append((pattern, k))
        if not state.any():
            incumbent, best = list(chosen), used
            stack.append(iter(()))
        elif used + lower_bound(state, capacity) >= best:
            stack.append(iter(()))
        else:
            stack.append(iter(children(state, allowance - k * waste)))
    return incumbent, bound


def pack(rows: DataFrame, order: list[str], capacity: int = 1024, nodes: int = 4000) -> DataFrame:
    """``rows`` (an integer column length, 1 to ``capacity``) with sequence_id and offset.

    Which of the rows of equal length goes where follows the hash of the columns ``order``, not
    the layout of files. The search completes a bin with at most 24 fillings, found in 40 x 24 steps,
    tests dominance for fillings of up to four pieces and visits at most ``nodes`` nodes; where these
    bind, the best solution found so far is returned, best-fit decreasing at worst. It and the lower bound are
    logged; no piece is lost. The driver holds the histogram of lengths and the patterns, both bounded
    by the capacity. A null length is no piece. ``rows`` is read three times: pass a table or a checkpoint. An empty table
    gives an empty result; clashing columns sequence_id and offset are replaced.
    """
    rows = rows.drop("sequence_id", "offset")
    rank_, pair = fresh(rows, "_place_rank"), fresh(rows, "_place")
    ranked, totals = numbered(rows.where("length is not null"), order, rank_, of="length")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in totals.items():
        if not 1 <= n <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        counts[n] = k
    patterns, bound = solve(counts, capacity, nodes)
    logging.getLogger(__name__).info("%d sequences, lower bound %d", sum(k for _, k in patterns), bound)
    slots, taken, base = [], {}, 0
    for pattern, k in patterns:
        at = 0
        for s in pattern:
            slots.append((s << 40 | taken.get(s, 0), base, at))
            taken[s] = taken.get(s, 0) + k
            at += s
        base += k
    slots.sort()
    keys, bases, offsets = (np.array([x[i] for x in slots], dtype=np.int64) for i in range(3))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = length.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64)
        i = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": bases[i] + key - keys[i], "offset": offsets[i]})

    return ranked.withColumn(pair, placed("length", rank_)).select("*", f"{pair}.sequence_id", f"{pair}.offset").drop(pair, rank_)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) in pieces (see :func:`pieces`) with their places.
    Repeated rows are packed as often as they occur; a null text is packed as an empty one; texts of
    any length are cut, never dropped. Extra columns are ignored; an empty table gives an empty result."""
    made = cut(pieces(docs, tokenizer, capacity, keep_ids=keep_ids))
    out = pack(made, ["doc_id", "piece", "start", "ids_crc32"], capacity)
    return out.withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with their ids: the training rows. A group is one
    sequence, at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("h")).select("sequence_id", F.unhex("h").alias("ids"))
