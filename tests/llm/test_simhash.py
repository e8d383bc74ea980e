import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilspark.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    """fps: list of (doc_id, fp). Brute force over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((doc, least[find(i)]) for i, (doc, _) in enumerate(fps)), key=str)


def documents(n=120):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = rnd.choices(vocabulary, k=rnd.choice([1, 3, 30, 150, 700]))
        rows.append((i + 10, " ".join(words)))
    return [*rows, (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "ÀB c"), (5, "Àb c d"), (None, "w1 w2 w3"), (rows[0][0], rows[0][1])]


def test_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id) == sorted((d, f"{f:016x}") for d, f in fps if d)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == plain_components(fps)


@pytest.mark.parametrize(("blocks", "dense"), [(3, 2048), (3, 3), (1, 2048), (2, 5), (5, 2048)])
def test_links_keep_every_pair_connected(spark, blocks, dense):
    rnd = random.Random(blocks * 10 + dense)
    fps = {0}
    for _ in range(25):
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 12])):
            fps.add(f)
            for _ in range(rnd.randrange(1, 6)):
                f ^= 1 << rnd.randrange(64)
    signed = sorted(f - (f >> 63 << 64) for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = [tuple(r) for r in simhash.links(nodes, 4, blocks, dense).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and a != b for a, b in found)
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in found:
        root[find(a)] = find(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert find(a) == find(b)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_of_repeated_ids_with_different_texts(spark):
    rnd = random.Random(6)
    x, y, z, u = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(1, x), (5, x), (5, y), (6, z), (6, u), (6, u), (7, u), (None, y), (None, "alone " * 9), (None, "alone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, x), (5, y), (6, z), (6, u), (None, "alone " * 9)], key=str)


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_keep_one_by_similarity(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(3000)}"
    rows, pairs = [], []
    for i in range(400):
        words = [word() for _ in range(rnd.choice([40, 100, 300, 900]))]
        other = list(words)
        for _ in range(rnd.randrange(1, 2 + len(words) // (10 if i % 4 == 0 else 40))):
            other[rnd.randrange(len(other))] = word()
        rows += [(2 * i, " ".join(words), "x"), (2 * i + 1, " ".join(other), "y")]
        pairs.append((2 * i + 1, jaccard(rows[-2][1], rows[-1][1])))
    rows += [(5000 + i, t, "z") for i, t in enumerate(["one", "one ", "two", "one two three", "one two three four", "one two three four five"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, w1 string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert all(2 * i in kept for i in range(400))
    close, alike, apart = ([d not in kept for d, j in pairs if low <= j < high] for low, high in ((0.9, 1.1), (0.8, 0.9), (0, 0.72)))
    assert len(close) > 50 and all(close)
    assert len(alike) > 50 and sum(alike) >= 0.9 * len(alike)
    assert len(apart) > 20 and not any(apart)
    assert kept & set(range(5000, 5006)) == {5000, 5002, 5003, 5004, 5005}


def test_wide_bits_against_plain():
    rnd = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 300, 0, 255, 256])
    h = rnd.integers(0, 1 << 63, int(sizes.sum())).astype(np.uint64)
    got = np.unpackbits(simhash.majorities(h, sizes), axis=1, bitorder="little")
    at = 0
    for row, n in zip(got, sizes.tolist(), strict=True):
        for j, factor in enumerate(simhash.multipliers(8, 21)):
            x = simhash.scramble((h[at : at + n] ^ (h[at : at + n] >> np.uint64(32))) * factor)
            want = [2 * sum(int(v) >> b & 1 for v in x) > n for b in range(64)]
            assert row[64 * j : 64 * j + 64].astype(bool).tolist() == want
        at += n


@pytest.mark.parametrize("size", [2, 16, 17, 300])
def test_meetings(size):
    rnd = np.random.default_rng(size)
    bits = np.uint64(1) << rnd.integers(0, 64, (size, 5)).astype(np.uint64)
    cluster = np.unique(np.bitwise_xor.reduce(bits, axis=1) ^ np.uint64(0x0F0F00FF12345678))
    far = rnd.integers(0, 1 << 63, 3).astype(np.uint64)
    keys = np.r_[np.full(len(cluster) + 3, -7), [1, 1, 5]]
    pairs = simhash.meetings(keys, np.r_[cluster, far, cluster[0], cluster[0] ^ np.uint64(3), far[0]], 20, {}).tolist()
    assert sorted([int(cluster[0]), int(cluster[0]) ^ 3]) in pairs
    root = {int(x): int(x) for x in np.r_[cluster, far]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        assert (a ^ b).bit_count() <= 20 and a < b
        if a in root and b in root:
            root[find(a)] = find(b)
    assert len({find(int(x)) for x in cluster}) == 1
    assert size <= 16 or len(pairs) < 40 * size
    parts, leaders = [], {}  # a bucket in parts
    for i in range(0, len(cluster), 7):
        parts += simhash.meetings(np.full(len(cluster[i : i + 7]), 4), cluster[i : i + 7], 20, leaders).tolist()
        leaders.setdefault(4, np.empty(0, np.uint64))
    assert size > 16 or size == 2 or parts


def test_through_hubs():
    """Pairs of one group go; of others each end meets the hub of the other's group, if it is near."""
    fps = np.array([0b1, 0b11, 0b111, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    hubs = np.array([0b1, 0b1, 0b1, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    pairs = np.array([[0b1, 0b11], [0b11, 0b111], [0b111, 1 << 40], [0b11, (1 << 64) - 1]], dtype=np.uint64)
    got = simhash.through_hubs(pairs, fps, hubs, 20).tolist()
    assert got == [[0b1, 1 << 40], [0b111, 1 << 40]]  # the far text stays far from the hub too
    assert simhash.through_hubs(pairs[:0], fps, hubs, 20).shape == (0, 2)


def test_of_like_size():
    known, sizes = np.array([3, 5, 9], dtype=np.uint64), simhash.steps(np.array([100, 128, 79]))
    pairs = np.array([[3, 5], [3, 9], [5, 9], [4, 9], [9, 12]], dtype=np.uint64)
    assert simhash.of_like_size(pairs, known, sizes, 21).tolist() == [[4, 9], [9, 12]]
    assert simhash.of_like_size(pairs, known, simhash.steps(np.array([100, 125, 80])), 21).tolist() == [[3, 5], [3, 9], [4, 9], [9, 12]]
    assert len(simhash.of_like_size(pairs, known[:0], sizes[:0], 21)) == 5 and not len(simhash.of_like_size(pairs[:0], known, sizes, 21))
    n = np.arange(1, 3000)
    assert (np.abs(simhash.steps(np.ceil(0.8 * n)).astype(int) - simhash.steps(n)) <= 21).all()  # no pair of 0.8 is lost
    assert simhash.steps(np.array([0, 1])).tolist() == [0, 0]


def test_copies_of_one_text_meet_it(spark):
    """Copies that are alike through their original alone are one group, however many they are."""
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randrange(10**6)}"
    words = [word() for _ in range(400)]
    rows = [(500, " ".join(words))]
    for i in range(300):
        other = list(words)
        for at in rnd.sample(range(0, 400, 5), 7):
            other[at] = word()
        rows.append((i, " ".join(other)))
    assert 0.8 < jaccard(rows[0][1], rows[1][1]) < 0.86 and jaccard(rows[1][1], rows[2][1]) < 0.75
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert 0 in kept and len(kept) <= 10


def test_spanning(spark):
    from veilspark.llm.common import components, groups, spanning

    rnd = random.Random(3)
    edges = [(rnd.randrange(30) + 100 * g, rnd.randrange(30) + 100 * g) for g in range(4) for _ in range(400)]
    df = spark.createDataFrame(edges, "a long, b long")
    for at_once in (1 << 20, 100):
        some = spanning(df, at_once)
        assert some.count() < (120 if at_once > 1000 else 1600)
        whole = sorted(tuple(r) for r in components(df).collect())
        assert sorted(tuple(r) for r in components(some).collect()) == whole
        assert sorted(tuple(r) for r in groups(df.union(df.selectExpr("a", "a")).unionAll(spark.createDataFrame([(77, 77)], df.schema)), at_once).collect()) == sorted({*whole, *((r, r) for _, r in whole)})
    assert not groups(df.limit(0)).count()
