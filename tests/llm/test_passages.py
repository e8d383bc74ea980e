import random

import numpy as np
import pytest

from veilspark.llm import passages
from veilspark.llm.decontaminate import overlap


def table(seed=4, n=60):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    shared = [[word() for _ in range(k)] for k in (51, 60, 140, 30, 400)]
    rows = []
    for d in range(n):
        words = [word() for _ in range(rnd.choice([0, 3, 60, 500]))]
        for s in rnd.sample(shared, rnd.choice([0, 1, 1, 2])):
            piece = list(s)
            if rnd.random() < 0.3:
                for k in range(25, len(piece), 40):
                    piece[k] = word()
            if rnd.random() < 0.3 and len(piece) > 70:
                del piece[40:43]
            at = rnd.randrange(len(words) + 1)
            words = words[:at] + piece + words[at:]
        rows.append((d * 3, " ".join(words)))
    hot = " ".join(word() for _ in range(55))
    rows += [(1000 + i, f"{word()} {word()} {hot} {word()}") for i in range(40)]
    rows += [(500, rows[7][1]), (501, rows[7][1].upper()), (502, None), (None, rows[7][1]), (503, ""), (504, "same " * 3000), (505, "same " * 3000), (1000, rows[60][1])]
    return rows


def exact_runs(a, b, least):
    """Maximal common runs of at least ``least`` words, as [start, end) in a."""
    out, before = [], [0] * (len(b) + 1)
    for i in range(len(a)):
        now = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                now[j + 1] = before[j] + 1
                if now[j + 1] >= least and (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]):
                    out.append((i + 1 - now[j + 1], i + 1))
        before = now
    return out


def test_against_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, other int, words string")
    got = [tuple(r) for r in passages.repeated_passages(df).collect()]
    texts = {d: (t or "").lower().split() for d, t in rows if d is not None}
    assert (505, 0, 3000, 504, 0, 3000, 3000, 3000) in got
    covered = {}
    for d, s, e, o, os, oe, n, m in got:
        assert o < d and n == e - s >= 50 and m >= 0.8 * n
        assert 0 <= os < oe <= len(texts[o]) and e <= len(texts[d])
        covered.setdefault(d, set()).update(range(s, e))
    for d in texts:
        missed = [run for o in texts if o < d and (o, d) != (504, 505) for run in exact_runs(texts[d], texts[o], 50) if not set(range(*run)) <= covered.get(d, set())]
        assert not missed
        if not any(exact_runs(texts[d], texts[o], 16) for o in texts if o < d):
            assert d not in covered


def test_cut_keeps_the_first_holder(spark):
    rows = table()
    df = spark.createDataFrame([(*r, "en", "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = passages.repeated_passages(df)
    out = passages.cut_passages(df, found)
    assert out.columns == df.columns
    left = {r.doc_id: r for r in out.collect()}
    flagged = {r.doc_id for r in found.select("doc_id").collect()}
    for d, t in rows:
        if d not in flagged:
            assert left[d].text == t and left[d].n_chars == 5
        elif d in left:
            assert left[d].n_chars == len(left[d].text) < len(t)
    assert 501 not in left  # a whole copy
    # cutting may bring the halves of a passage together, and does nothing else
    assert {r.doc_id for r in passages.repeated_passages(out).collect()} <= flagged


def test_a_passage_twice_in_one_document(spark):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows, copies = [], {}
    for i in range(20):
        passage, fill = [word() for _ in range(60)], [[word() for _ in range(70)] for _ in range(5)]
        changed = [*passage[:30], "other", *passage[31:]]
        rows.append((2 * i, " ".join(fill[0] + passage + fill[1])))
        rows.append((2 * i + 1, " ".join(fill[2] + passage + fill[3] + changed + fill[4] + passage)))
        copies[2 * i + 1] = {(70, 130), (200, 260), (330, 390)}
    rows += [(900, "same " * 100), (901, "same " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs)
    got = [tuple(r) for r in found.collect()]
    for d, want in copies.items():
        assert {(s, e) for doc, s, e, *_ in got if doc == d} == want
    periodic = [(s, e) for d, s, e, *_ in got if d == 901]
    assert set().union(*(range(*x) for x in periodic)) == set(range(3000)) and len(periodic) < 300
    left = {r.doc_id: r.text.split() for r in passages.cut_passages(docs, found).collect()}
    assert 901 not in left and all(len(left[d]) == 210 for d in copies)


def test_a_passage_of_pieces_from_earlier_documents(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows, want = [], {}
    for i in range(60):
        pieces = [[word() for _ in range(k)] for k in ((26, 26), (30, 30), (45, 45), (20, 20, 20))[i % 4]]
        whole = [w for piece in pieces for w in piece]
        for j, piece in enumerate(pieces):
            rows.append((10 * i + j, " ".join([word() for _ in range(70)] + piece + [word() for _ in range(70)])))
        for j in (5, 6):
            rows.append((10 * i + j, " ".join([word() for _ in range(80)] + whole + [word() for _ in range(80)])))
        want[10 * i + 6] = (80, 80 + len(whole))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs)
    covered = {}
    for d, s, e, *_ in found.collect():
        covered.setdefault(d, set()).update(range(s, e))
    assert [d for d, span in want.items() if not covered.get(d, set()) >= set(range(*span))] == []
    assert covered.keys() == want.keys()


@pytest.mark.parametrize("seed", range(5))
def test_starts_miss_no_shared_window(seed):
    rnd = np.random.default_rng(seed)
    shared = rnd.integers(0, 1 << 60, 46).astype(np.uint64)
    texts = [np.r_[rnd.integers(0, 1 << 60, n).astype(np.uint64), shared, rnd.integers(0, 1 << 60, 40).astype(np.uint64)] for n in (0, 33)]
    at = [passages.winnow(h) for h in texts]
    both = set(texts[0][at[0]].tolist()) & set(texts[1][at[1]].tolist())
    for n, h, x in zip((0, 33), texts, at, strict=True):
        assert n in passages.starts(np.array([i for i in x if int(h[i]) in both]), 50)


def test_remove():
    cut = lambda text, *spans: passages.remove(text.encode(), np.array([a for a, _ in spans]), np.array([b for _, b in spans])).decode()
    assert cut(" a é\tb  c d\n", (1, 3)) == " a c d\n"
    assert cut("a b a b", (2, 4), (3, 9)) == "a b "
    assert cut("a b c", (1, 2), (0, 1)) == "c" and cut("", (0, 3)) == "" and cut(" \n", (0, 3)) == " \n"


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_one_by_one(seed):
    rnd = np.random.default_rng(seed)
    parts = [rnd.random(n) < share for n, share in zip(rnd.integers(0, 200, 60), rnd.random(60), strict=True)]
    edges = np.r_[0, np.cumsum([len(x) for x in parts])]
    got = list(zip(*(x.tolist() for x in passages.runs(np.concatenate(parts), edges, 12)), strict=True))
    want = []
    for k, same in enumerate(parts):
        todo = [(0, len(same))]
        while todo:
            low, high = todo.pop()
            a, b = overlap(same[low:high])
            if b > a:
                want += [(k, int(edges[k]) + low + a, int(edges[k]) + low + b)] * (b - a >= 12)
                todo += [(low, low + a), (low + b, high)]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_uncovered_against_sets(seed):
    rnd = np.random.default_rng(seed)
    spans = [(int(r), int(b), int(b + n)) for r, b, n in zip(rnd.integers(0, 5, 30), rnd.integers(0, 900, 30), rnd.integers(1, 200, 30), strict=True)]
    held = [{i for r, b, e in spans if r == row for i in range(b, e)} for row in range(6)]
    row, at = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(0, 1000, 7)))
    got = passages.uncovered(row, at, passages.union(*map(np.array, zip(*spans, strict=True))), 50)
    assert got.tolist() == [not held[r] >= set(range(a, a + 50)) for r, a in zip(row.tolist(), at.tolist(), strict=True)]


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_fenwick(n):
    rnd = random.Random(n)
    tree, plain = passages.Fenwick(n), {}
    for i in range(100):
        at, v = rnd.randrange(n), rnd.random()
        tree.put(at, (v, i))
        plain[at] = max(plain.get(at, (-1e300, -1)), (v, i))
        q = rnd.randrange(n + 1)
        assert tree.below(q) == max([(-1e300, -1), *(x for k, x in plain.items() if k < q)])


def test_winnowing_guarantee():
    h = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    at = passages.winnow(h, 7)
    assert all(any(i <= a < i + 7 for a in at) for i in range(len(h) - 6))
    assert len(at) < 0.35 * len(h)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    found = passages.repeated_passages(df)
    assert found.count() == 0 and passages.cut_passages(df, found).count() == 0


def test_odd_rows_are_cut(spark):
    rnd = random.Random(7)
    shared = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(1, f"a {shared}", 1, "x"), (2, f"b {shared} c", 2, None), (2, f"b {shared} c", 2, None), (None, shared, None, "y"), (3, None, 3, "z"), (4, "", 4, "z"), (5, shared, 5, "z"), (6, f"long {shared} " + "tail " * 200_000, 6, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _spans int, _id string")
    out = [tuple(r) for r in passages.cut_passages(df, passages.repeated_passages(df)).collect()]
    assert sorted(map(str, (r for r in out if r[0] != 6))) == sorted(map(str, [rows[0], (2, "b c", 2, None), (2, "b c", 2, None), *rows[3:6]]))
    assert [r[1].split()[0] for r in out if r[0] == 6] == ["long"] and shared not in [r[1] for r in out if r[0] == 6][0]
