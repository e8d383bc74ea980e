import random

import numpy as np
import pytest

from veilspark.llm import decontaminate
from veilspark.llm.words import hashes, plain_words


def brute(docs, items, least=13):
    """Every diagonal of every pair, and the best run of each by enumeration."""
    unique = {}
    for i, t in items:
        w = tuple(plain_words((t or "").encode()))
        i = -1 if i is None else i
        if len(w) >= 5:
            unique[w] = min(unique.get(w, i), i)
    out = {}
    for d, t in docs:
        doc = plain_words((t or "").encode())
        for words, i in unique.items():
            for shift in range(-len(words) + 1, len(doc)):
                same = [0 <= k + shift < len(doc) and w == doc[k + shift] for k, w in enumerate(words)]
                inside = [0 <= k + shift < len(doc) for k in range(len(words))]
                runs = [(sum(1 if x else -4 for x in same[a:b]), a, b) for a in range(len(words)) for b in range(a, len(words) + 1) if all(inside[a:b])]
                top = max(r[0] for r in runs)
                a, b = next((a, b) for s, a, b in sorted(runs, key=lambda r: (r[2], r[1])) if s == top)
                if top > 0 and b - a >= decontaminate.required(len(words), least):
                    out[d, i] = max(out.get((d, i), 0), sum(same[a:b]))
    return out


def tables():
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([4, 6, 9, 14, 40])))) for i in range(25)]
    docs = []
    for d in range(50):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 20, 80]))
        if d % 2:
            piece = items[rnd.randrange(25)][1].split(" ")
            if d % 3 == 0:
                piece = piece[len(piece) // 4 :]
            if d % 5 == 0 and len(piece) > 9:
                piece[len(piece) // 2] = "other"
            at = rnd.randrange(len(words) + 1)
            words = words[:at] + piece + words[at:]
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words)))
    items += [(90, items[3][1]), (None, "n1 n2 n3 n4 n5 n6"), (91, None), (92, "")]
    docs += [(100, None), (None, items[4][1]), (101, "n1 n2! n3\nn4 n5 n6")]
    return docs, items


@pytest.mark.parametrize("slice_seeds", [400_000, 300])
def test_against_brute_force(spark, slice_seeds):
    docs, items = tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.contaminated(d, b, slice_seeds=slice_seeds).collect()}
    want = brute(docs, items)  # what substitutions hide from all seeds may be missing, nothing else
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)
    texts = {d: " ".join(w.decode() for w in plain_words((t or "").encode())) for d, t in docs}
    for (d, i), n in want.items():
        whole = [" ".join(w.decode() for w in plain_words((t or "").encode())) for j, t in items if j == i or i == -1 and j is None]
        if f" {whole[0]} " in f" {texts[d]} ":
            assert got[d, i] == n
    assert (101, -1) in got and (None, 4) in got or len(items[4][1].split()) < 5


def test_substitutions_are_tolerated(spark):
    words = [f"w{i}" for i in range(30)]
    for k in range(0, 30, 7):
        words[k] = "sub"
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.words) for r in decontaminate.contaminated(d, b).collect()] == [(1, 5, 27)]


def test_a_short_run_hides_no_longer_one(spark):
    item = [f"w{i}" for i in range(33)]
    doc = [f"x{i}" if 12 <= i < 16 or i == 24 else w for i, w in enumerate(item)]
    d = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(doc[::-1])), (3, " ".join(item[:12]))], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(d, b).collect()] == [(1, 5, 16, 16, 17, 16)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 3]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert decontaminate.contaminated(d, b).count() == decontaminate.contaminated(full, b).count() == 0
    assert decontaminate.contaminated(d, full.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_overlap():
    assert decontaminate.overlap(np.array([1, 1, 0, 1, 1, 1, 1, 1, 1], dtype=bool)) == (3, 9)
    assert len(hashes([])) == 0
