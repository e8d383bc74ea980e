"""Near-duplicate documents by SimHash, linked by meet-in-the-middle ball hashing.

Method. A fingerprint's 64 bits are cut into three blocks. Of two fingerprints that differ in at
most ``distance`` = 4 bits, the block with the most differences holds at least two of them, so
outside that block at most two remain. For each of the three blocks that may be left out, every
fingerprint therefore emits all variants of its remaining bits within half of that radius, one
flipped bit; two linked fingerprints meet at a variant that lies between them. Variants are
shuffled, colliding fingerprints are verified on all 64 bits. 131 variants a fingerprint instead
of the 2081 that the ball of radius two around all 64 bits holds (``blocks=1`` emits those).

Groups. Equal fingerprints are one node, so copies never meet as pairs. A bucket of up to
``dense`` nodes is solved where it is: of the links inside it, a spanning forest is kept. The nodes of larger buckets emit the whole ball of radius two; any two nodes at
one of its points are at most four bits apart, so a star there needs no pairs and loses no link.

Similarity. Texts whose shingles have a Jaccard similarity of 0.8 differ in 15 % of their bits, ten of
64, and no ball of that radius can be emitted. :func:`keep_one` therefore takes 448 more bits, 14 words
of 32, and hashes balls in 28 bits of each: a fingerprint emits all variants of each word within
half of radius two, so similar texts meet in at least one word (94 % of those of 0.8, 99 % of those of
0.85). What meets is verified on all 512 bits, and by the shingles themselves if that estimate
is within 2.5 standard errors of the bar. The words are looked up in three rounds. A round's links make groups, each
with the text of most links as its hub. In the next round two texts of one group make no pair, as they are connected
already, and a text that meets one of another group is also compared with that group's hub: so the copies of one
text, that are like it but not like each other, do not meet pair by pair in bucket after bucket. Texts of too unlike lengths for the similarity make no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, fresh, groups, likely, spanning, stored
from .words import gram_hashes, hashed, multipliers, portions, scramble

BITS = 64
_MORE = 7  # words of 64 bits in a wide fingerprint, besides the fingerprint
_KEY = 28  # bits of each 32 of those that are looked up
_ROUNDS = (range(0, 1), range(1, 3), range(3, 2 * _MORE))  # the words of 32 bits that each round looks up
_TOGETHER = 16  # buckets up to this size are solved at once
#: A byte as a number whose bytes are the byte's bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text in UTF-8: A-Z lower-cased, words between ASCII white space, shingles of
    ``shingle`` words with repeats, XXH64; a bit is set if it is in over half of the hashes."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes: lower() and split() know ASCII only
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        grams: Iterator = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = n - shingle + 1
    hashes = np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(seed))), dtype=np.uint8).reshape(n, 8)
    if n < 512:
        counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        counts = np.concatenate([np.bincount(hashes[:, j], minlength=256) @ patterns for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row; a null text counts as one without words: fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(batch))
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(blocks: int, radius: int) -> list[tuple[int, int, np.ndarray]]:
    """For each choice of a left-out block: bits kept, tag, flips of up to ``radius`` kept bits."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    out = []
    for j in range(blocks):
        left_out = [] if blocks == 1 else list(range(edges[j], edges[j + 1]))
        kept = [b for b in range(BITS) if b not in left_out]
        flips = [0]
        level = [(0, -1)]
        for _ in range(radius):
            level = [(f | 1 << kept[i], i) for f, last in level for i in range(last + 1, len(kept))]
            flips += [f for f, _ in level]
        keep = sum(1 << b for b in kept)
        tag = 0 if blocks == 1 else (j + 1) << left_out[0]  # the left-out bits are free to tell the choices apart
        out.append((keep, tag, np.array(flips, dtype=np.uint64)))
    return out


def variants(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(key, fp): every point of the ball around each fingerprint, for each left-out block."""
    rest = distance if blocks == 1 else distance - -(-distance // blocks)  # differences outside the worst block
    masks = _masks(blocks, -(-rest // 2))

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 500):
                part = fps[at : at + 500]
                for keep, tag, flips in masks:
                    keys = (((part & np.uint64(keep))[:, None] ^ flips[None, :]) | np.uint64(tag)).ravel()
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within ``distance`` that span each connected part of the fingerprints."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    left, out = np.ones(len(fps), dtype=bool), []
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first], reached = False, [first]
        while reached:
            i = reached.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            reached += new.tolist()
            out += [(int(max(fps[i], fps[j])), int(min(fps[i], fps[j]))) for j in new]
    return out


def _bucket_links(distance: int, dense: int):
    def run(batches):
        key_left, fp_left, spilled = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def solve(keys, fps):
            a, b = [], []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            x, y = fps[two], fps[two + 1]
            ok = (np.bitwise_count(x ^ y) <= distance) & (x != y)
            a.append(np.maximum(x[ok], y[ok]))
            b.append(np.minimum(x[ok], y[ok]))
            many = []
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if n > dense:
                    many.append(fps[s : s + n])
                elif tree := _forest(fps[s : s + n], distance):
                    a.append(np.array([p for p, _ in tree], np.uint64))
                    b.append(np.array([q for _, q in tree], np.uint64))
            return np.concatenate(a), np.concatenate(b), many

        def emit(a, b, many):
            for group in many:  # a node of a large bucket: no partner yet
                a, b = np.r_[a, group], np.r_[b, group]
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.r_[key_left, batch.column("key").to_numpy()]
            fps = np.r_[fp_left, batch.column("fp").to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # sorted: the last key may go on
            if spilled is not None:  # the rest of a bucket too large to hold
                n = int(np.searchsorted(keys, spilled, side="right"))
                yield from emit(fps[:0], fps[:0], [fps[:n]])
                if n == len(keys):
                    key_left, fp_left = keys[:0], fps[:0]
                    continue
                keys, fps, last, spilled = keys[n:], fps[n:], last - n, None
            if last:
                yield from emit(*solve(keys[:last], fps[:last]))
            key_left, fp_left = keys[last:], fps[last:]
            if len(key_left) > dense:
                yield from emit(fp_left[:0], fp_left[:0], [fp_left])
                spilled, key_left, fp_left = key_left[0], key_left[:0], fp_left[:0]
        if len(key_left):
            yield from emit(*solve(key_left, fp_left))

    return run


def links(nodes: DataFrame, distance: int = 4, blocks: int = 3, dense: int = 2048) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most ``distance`` bits apart, enough of them that
    any two such fingerprints are connected."""
    if distance % 2 or not 1 <= blocks <= distance + 1:
        raise ValueError("distance must be even, blocks between 1 and distance + 1")
    met = variants(nodes, distance, blocks).repartition("key").sortWithinPartitions("key")
    found = cut(met.mapInArrow(_bucket_links(distance, dense), "a long, b long").distinct())
    sure = found.where("a <> b")
    crowded = found.where("a = b").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return sure
    ball = variants(crowded, distance, 1)
    point = ball.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c").select("key", "b")
    star = ball.join(point, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return sure.union(star)


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fingerprint
    (16 lowercase hex digits), component_id (smallest doc_id reachable over links of at most
    ``distance`` differing bits).

    Null and word-less texts have fingerprint zero and link like any other. Rows with equal
    doc_id stay separate rows. A null doc_id gets a fingerprint and its component's smallest
    non-null doc_id (null if there is none). An empty table gives an empty result.
    """
    base = cut(fingerprints(docs, shingle))
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = _classes(nodes, links(nodes, distance, blocks))
    return base.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each distinct fingerprint (fp, least)."""
    roots = components(linked)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # a table of its own leaves the join free to split a large component
    smallest = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(smallest, "root").select("fp", "component_id", "root")


# --- by similarity ---------------------------------------------------------------------------


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text a row of 8 + 8 x _MORE bytes: the bits set in over half of its shingles, for
    independent 64-bit hashes made of each shingle's hash. ``sizes``: how many of ``h`` are each text's."""
    out = np.zeros((len(sizes), 8 * (1 + _MORE)), dtype=np.uint8)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    parts = -(-n // 255)  # sums of up to 255 bits fit a byte
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    for j, factor in enumerate(multipliers(1 + _MORE, 21)):
        octets = scramble((h ^ (h >> np.uint64(32))) * factor).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums = np.add.reduceat(_LANES[octets[:, k]], begin).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(sums.astype(np.int64), first, axis=0)
            out[some, 8 * j + k] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")[:, 0]
    return out


def _grams(words: np.ndarray, edges: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles (the whole of a text that is shorter), end to end, and how many they are."""
    n = np.diff(edges)
    sizes = np.where(n < shingle, np.minimum(n, 1), n - shingle + 1)
    row = np.repeat(np.arange(len(n)), sizes)
    at = edges[row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    grams = gram_hashes(words, list(range(shingle)))
    h = grams[np.minimum(at, len(grams) - 1)] if len(grams) else np.zeros(len(row), dtype=np.uint64)
    for i in np.flatnonzero(n[row] < shingle).tolist():
        whole = words[edges[row[i]] : edges[row[i] + 1]]
        h[i] = gram_hashes(whole, list(range(len(whole))), 4)[0]
    return h, sizes


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()


def wide_bits(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of :func:`majorities` for texts in UTF-8, with the words and shingles of
    :func:`fingerprint`; no words: all bits zero. And how many shingles each text has."""
    h, sizes = _grams(*hashed(texts, _split), shingle)
    return majorities(h, sizes), sizes


def steps(sizes: np.ndarray) -> np.ndarray:
    """Numbers of shingles in steps of a 64th of a doubling."""
    return (64 * np.log2(np.maximum(sizes, 1))).astype(np.int16)


def wide_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 5) -> DataFrame:
    """The columns ``keep`` of each row, a fingerprint of 64 bits (fp), 448 more (w1 .. w7) and the number of shingles
    in :func:`steps` (size); names that clash get an underscore in front."""
    names = ["fp", *(f"w{i + 1}" for i in range(_MORE)), "size"]
    own = [fresh(docs, c) for c in names]

    def run(batches):
        for b in batches:
            told = [wide_bits(texts, shingle) for _, texts in portions(b.column("text"))]
            numbers = np.concatenate([bits for bits, _ in told]).view("<i8") if told else np.empty((0, 1 + _MORE), dtype=np.int64)
            sizes = steps(np.concatenate([np.empty(0, dtype=np.int64), *(n for _, n in told)]))
            yield pa.record_batch([*(b.column(c) for c in keep), *(pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(1 + _MORE)), pa.array(sizes)], [*keep, *own])

    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = T.StructType([f for f in rows.schema if f.name in keep])
    for c in own:
        schema = schema.add(c, "short" if c == own[-1] else "long")
    return rows.mapInArrow(run, schema)


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which texts of a Jaccard similarity differ: their shingle
    counts have the cosine 2J / (1 + J) if the texts are equally long, a smaller one if not."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _word_variants(nodes: DataFrame, looked_up: range) -> DataFrame:
    """(key, fp, hub, size): for each of those words of a node all variants of its key bits within one flip;
    hub: in what bits the hub of the node's group differs from it (zero for most, so it takes little room)."""
    flips = np.r_[0, 1 << np.arange(_KEY)].astype(np.uint32)
    own = np.array(looked_up)
    tags = own.astype(np.uint32) << np.uint32(_KEY)

    def run(batches):
        for b in batches:
            fps, hubs, sizes = (b.column(c).to_numpy() for c in ("fp", "hub", "size"))
            words = np.stack([b.column(f"w{i + 1}").to_numpy() for i in range(_MORE)], axis=1).view("<u4")[:, own]
            for at in range(0, len(fps), 250):
                part = words[at : at + 250] & np.uint32((1 << _KEY) - 1) | tags
                keys = (part[:, :, None] ^ flips).reshape(len(part), -1)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int32)), *(pa.array(np.repeat(c[at : at + 250], keys.shape[1])) for c in (fps, hubs, sizes))], ["key", "fp", "hub", "size"])

    return nodes.mapInArrow(run, "key int, fp long, hub long, size short")


def meetings(keys: np.ndarray, fps: np.ndarray, near: int, leaders: dict[int, np.ndarray]) -> np.ndarray:
    """Pairs (rows of two) of fingerprints under equal keys, ascending, that differ in at most ``near`` bits:
    each fingerprint with those of its bucket's leaders that are near, each being near one or a
    leader itself. Leaders are the most central ones: of a text and its many copies, that text.
    ``leaders``: those of a bucket whose part this is."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    whole = np.array([int(k) not in leaders for k in keys[starts]], dtype=bool) if leaders else np.ones(len(starts), dtype=bool)
    out = [np.empty((0, 2), dtype=np.uint64)]

    def add(x, y):
        ok = np.bitwise_count(x ^ y) <= near
        out.append(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]], axis=1))

    alone = ~whole | (sizes > _TOGETHER)
    for size in range(2, _TOGETHER + 1):
        own = np.flatnonzero(~alone & (sizes == size))
        members = np.sort(fps[starts[own][:, None] + np.arange(size)], axis=1)
        if size == 2:
            add(members[:, 0], members[:, 1])
            continue
        leader = members[np.arange(len(own)), central(members)]
        far = (np.bitwise_count(members ^ leader[:, None]) > near).any(axis=1)
        alone[own[far]] = True  # of several leaders
        for i in range(size):
            add(leader[~far], members[~far, i])
    for s, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True):
        bucket, known = np.sort(fps[s : s + n]), list(leaders.get(int(keys[s]), ()))
        left = np.ones(n, dtype=bool)
        while known or left.any():
            if known:
                leader = known.pop()
            else:
                leader = bucket[left][central(bucket[left][None])[0]]
                leaders[int(keys[s])] = np.r_[leaders.get(int(keys[s]), np.empty(0, np.uint64)), leader]
            add(np.full(n, leader), bucket)
            left &= np.bitwise_count(bucket ^ leader) > near
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def central(buckets: np.ndarray) -> np.ndarray:
    """For each row of fingerprints the place of the one that differs least from the majority of each bit."""
    bits = np.unpackbits(np.ascontiguousarray(buckets).view(np.uint8).reshape(*buckets.shape, 8), axis=2, bitorder="little")
    middle = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > buckets.shape[1], axis=1, bitorder="little").view(np.uint64)
    return np.argmin(np.bitwise_count(buckets ^ middle), axis=1)


def through_hubs(pairs: np.ndarray, known: np.ndarray, hubs: np.ndarray, near: int) -> np.ndarray:
    """The pairs whose ends are of different groups, and of each also either end with the hub of the other one and
    both hubs, as far as these differ in at most ``near`` bits. ``hubs``: of the fingerprints ``known`` (ascending)."""
    x, y = pairs[:, 0], pairs[:, 1]
    p, q = hubs[np.searchsorted(known, x)], hubs[np.searchsorted(known, y)]
    x, y, p, q = (v[p != q] for v in (x, y, p, q))
    ends = np.concatenate([np.stack(two, axis=1) for two in ((x, y), (x, q), (p, y), (p, q))])
    ends.sort(axis=1)
    return np.unique(ends[np.bitwise_count(ends[:, 0] ^ ends[:, 1]) <= near], axis=0)


def of_like_size(pairs: np.ndarray, known: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The pairs whose ends' sizes are at most ``most`` :func:`steps` apart, or not both known. ``sizes``: of the
    fingerprints ``known`` (ascending)."""
    at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
    told = (known[at] == pairs).all(axis=1) if len(known) else np.zeros(len(pairs), dtype=bool)
    far = np.abs(np.diff(sizes[at].astype(np.int64), axis=1)[:, 0]) > most if len(known) else told
    return pairs[~(told & far)]


def _met(nodes: DataFrame, looked_up: range, near: int, similarity: float) -> DataFrame:
    """(a, b): pairs of the nodes (fp, hub, size, w1 .. w7) of different groups that meet in one of those words
    and are not too unlike in size for the similarity: the smaller has that share of the larger one's shingles."""
    most = math.floor(64 * math.log2(1 / similarity)) + 1  # of rounded steps

    def run(batches):
        held, size, leaders = [], 0, {}
        # leaders of a bucket that goes on, their hubs and sizes
        seen = [np.empty(0, dtype=kind) for kind in (np.uint64, np.uint64, np.int16)]

        def solve(keys, fps, hubs, sizes):
            nonlocal seen
            pairs = meetings(keys, fps, near, leaders)
            known, at = np.unique(np.r_[fps, seen[0]], return_index=True)
            hub, length = np.r_[fps ^ hubs, seen[1]][at], np.r_[sizes, seen[2]][at]
            if (hub != known).any():
                pairs = through_hubs(pairs, known, hub, near)
            pairs = of_like_size(pairs, known, length, most)
            led = np.unique(np.concatenate([fps[:0], *leaders.values()]))
            at = np.searchsorted(known, led)
            seen = [led, hub[at], length[at]]
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in range(2)], ["a", "b"])

        for b in batches:
            held.append((b.column("key").to_numpy(), *(b.column(c).to_numpy().view(np.uint64) for c in ("fp", "hub")), b.column("size").to_numpy()))
            size += len(b)
            if size < 1 << 17:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # sorted: the last key may go on
            if last:
                yield solve(*(c[:last] for c in rows))
                leaders.clear()
                rows = [c[last:] for c in rows]
            if len(rows[0]) > 1 << 16:  # a bucket too large to hold: its leaders stay
                yield solve(*rows)
                leaders.setdefault(int(rows[0][-1]), np.empty(0, np.uint64))
                rows = [c[:0] for c in rows]
            held, size = [rows], len(rows[0])
        if size:
            yield solve(*(np.concatenate(c) for c in zip(*held, strict=True)))

    met = _word_variants(nodes, looked_up).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a long, b long").distinct()


def _hubs(linked: DataFrame) -> DataFrame:
    """(fp, hub) of each linked fingerprint: that of its group with most links, of several the smallest."""
    ends = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    named = cut(groups(linked).join(ends, "node"))
    # a table of its own leaves the join free to split a large group
    most = cut(named.groupBy("root").agg(F.min(F.struct(-F.col("n"), "node")).alias("hub")).select("root", "hub.node").withColumnRenamed("node", "hub"))
    return named.join(most, "root").select(F.col("node").alias("fp"), "hub")


def similar(nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): pairs of the nodes (fp, least, digest, size, w1 .. w7) of that similarity: of those that
    :func:`_word_variants` lets meet, as many as connect them. ``docs``: the texts (doc_id, text) of the nodes, each under
    its ``least`` and with the XXH64 ``digest``; a node without an id has only its bits."""
    share = differing(similarity)
    near = math.ceil(BITS * share + 3.6 * math.sqrt(BITS * share * (1 - share)))
    words = [f"w{i + 1}" for i in range(_MORE)]
    sides = {side: nodes.select(F.col("fp").alias(side), F.col("least").isNull().alias(f"bare_{side}"), *[F.col(w).alias(f"{side}{w}") for w in words]) for side in "ab"}
    apart = reduce(Column.__add__, [F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), *[F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words]])
    bits = BITS * (1 + _MORE)
    error = 2.5 * math.sqrt(bits * share * (1 - share))
    close, bare = F.col("apart") <= bits * share - error, F.col("bare_a") | F.col("bare_b")
    found, placed = None, nodes.withColumn("hub", F.lit(0).cast("long"))
    for looked_up in _ROUNDS:
        if found is not None:
            placed = nodes.join(_hubs(found), "fp", "left").withColumn("hub", F.coalesce(F.col("fp").bitwiseXOR(F.col("hub")), F.lit(0)))
        pairs = _met(placed.select("fp", "hub", "size", *words), looked_up, near, similarity)
        for side in "ab":
            pairs = pairs.join(sides[side], side)
        pairs = cut(pairs.select("a", "b", apart.alias("apart"), bare.alias("bare")).where(F.col("apart") <= bits * share + error))
        sure = pairs.where(close | F.col("bare") & (F.col("apart") <= bits * share)).select("a", "b")
        new = sure.union(_verified(pairs.where(~close & ~F.col("bare")).select("a", "b"), nodes, docs, similarity, shingle))
        found = cut(new if found is None else found.union(new))
    return found


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose texts' shingles, repeats counted, have that Jaccard similarity or a larger one."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = cut(wanted.join(nodes.select("fp", "least", "digest"), "fp"))
    texts = docs.select(F.col("doc_id").alias("least"), "text", F.xxhash64("text").alias("digest"))
    some = likely(texts, "least", wanted.select("least"), "some").where("some").drop("some")
    some = some.join(wanted.hint("merge"), ["least", "digest"]).select("fp", "text")

    def grams(batches):
        for b in batches:
            for first, texts in portions(b.column("text")):
                h, sizes = _grams(*hashed(texts, _split), shingle)
                ends = np.cumsum(sizes)
                lists = [np.sort((h[e - n : e] >> np.uint64(32)).astype("<u4")).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([b.column("fp").slice(first, len(texts)), pa.array(lists, pa.binary())], ["fp", "grams"])

    held, _ = stored(some.mapInArrow(grams, "fp long, grams binary"), "grams")
    met = pairs
    for side in "ab":
        met = met.join(held.select(F.col("fp").alias(side), F.col("grams").alias(f"grams_{side}")), side)

    def alike(x, y):
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        (x, m), (y, n) = (np.unique(z, return_counts=True) for z in (x, y))
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = int(np.minimum(m[i], n[j]).sum())
        return shared >= similarity * (int(m.sum() + n.sum()) - shared)

    def run(batches):
        for b in batches:
            ok = [alike(x, y) for x, y in zip(b.column("grams_a").to_pylist(), b.column("grams_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, whole: the one with its smallest doc_id, of several
    such rows any; any row, if none has an id. Groups are connected by links of ``similarity``
    (Jaccard) over shingles of ``shingle`` words with repeats, see :func:`similar`; texts without words are one group, as are texts of
    equal fingerprints. Extra columns are kept; an empty table gives an empty result. Rows that stay
    are not shuffled, but for a few."""
    words = [f"w{i + 1}" for i in range(_MORE)]
    base = cut(wide_fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), ["doc_id", "digest"], shingle))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest", "size")))
    nodes = base.groupBy("fp").agg(first.alias("first"), F.min(F.struct(*words, "size")).alias("w"))
    nodes = cut(nodes.select("fp", F.col("first.doc_id").alias("least"), "first.digest", F.coalesce("first.size", "w.size").alias("size"), *[F.col(f"w.{w}").alias(w) for w in words]))
    classes = cut(_classes(nodes.select("fp", "least"), spanning(similar(nodes, docs, similarity, shingle))))
    again = base.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = base.join(classes, "fp").where("doc_id <> component_id").select("doc_id").union(again)
    gone = cut(gone.distinct())
    some, gone_id = fresh(docs, "_some"), fresh(docs, "_gone")
    marked = likely(docs.where("doc_id is not null"), "doc_id", gone, some)
    few = marked.where(F.col(some)).join(gone.withColumnRenamed("doc_id", gone_id).hint("merge"), F.col("doc_id") == F.col(gone_id), "left_anti")
    kept = marked.where(~F.col(some)).union(few).drop(some)
    repeated = not again.isEmpty()
    if repeated or not base.where("doc_id is null").isEmpty():
        # an id that is missing or repeated does not tell a row's component
        loose = docs.where("doc_id is null")
        if repeated:
            twice = again.withColumnRenamed("doc_id", gone_id)
            loose = loose.union(docs.join(twice, F.col("doc_id") == F.col(gone_id), "left_semi"))
        fp, least, root = (fresh(docs, x) for x in ("fp", "_least", "_root"))
        loose = wide_fingerprints(loose, docs.columns, shingle)
        own = classes.select(F.col("fp").alias(fp), F.col("component_id").alias(least), F.col("root").alias(root))
        first = loose.join(own, fp).where(F.col("doc_id").eqNullSafe(F.col(least)))
        kept = kept.union(first.dropDuplicates([root]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept
