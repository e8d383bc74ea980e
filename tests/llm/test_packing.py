import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def valid(counts, patterns, capacity):
    back = np.zeros(capacity + 1, dtype=int)
    for p, k in patterns:
        assert sum(p) <= capacity and k > 0
        for s in p:
            back[s] += k
    assert (back == counts).all()


def optimum(items, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= items[i]}.values():
            room[j] -= items[i]
            go(i + 1, room)
            room[j] += items[i]
        room.append(capacity - items[i])
        go(i + 1, room)
        room.pop()

    go(0, [])
    return best[0]


def test_small_problems_reach_the_optimum():
    rnd = random.Random(1)
    for _ in range(60):
        items = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 11))), reverse=True)
        counts = np.bincount(items, minlength=21)
        patterns, bound = packing.solve(counts, 20)
        valid(counts, patterns, 20)
        assert bound <= sum(k for _, k in patterns) == optimum(items, 20)


def test_branch_and_bound_beats_best_fit():
    counts = np.bincount([6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 3 + [7, 3, 4], minlength=11)
    items = np.repeat(np.arange(11), counts)
    patterns, bound = packing.solve(counts, 10)
    valid(counts, patterns, 10)
    assert sum(k for _, k in patterns) == max(bound, -(-items.sum() // 10))


@pytest.mark.parametrize("seed", range(4))
def test_large_histograms(seed):
    counts = np.random.default_rng(seed).integers(0, 5000, 1025) * (np.arange(1025) >= (0, 1, 300, 513)[seed])
    counts[0] = 0
    patterns, bound = packing.solve(counts, 1024, nodes=300)
    valid(counts, patterns, 1024)
    assert bound <= sum(k for _, k in patterns) <= sum(k for _, k in packing.best_fit(counts, 1024))


def test_encoder_gives_the_library_s_ids(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|><|endoftext", "<|endoftext|>", "\r\n\t é 日本 🙂", "a" * 3000, " " * 500, "x\x00y"]
    library = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack_documents(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["alpha", "be", "gamma7", "é"], k=rnd.choice([0, 3, 90, 700, 3000])))) for i in range(80)]
    rows += [(5, rows[5][1]), (None, "null id"), (900, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, offset string, length int")
    made = packing.pack_documents(df, PATH, keep_ids=True).cache()
    got = made.collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024
        edges = sorted({0, first, *range(first, len(ids) + 1, 1024)})
        want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 1024
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(made).collect()}
    for r in got:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    made.unpersist()


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_the_bound_is_logged(spark, caplog):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([6, 6, 4, 4, 5])], "id long, length int")
    with caplog.at_level("INFO", logger="veilspark.llm.packing"):
        assert packing.pack(rows, ["id"], 10).agg({"sequence_id": "max"}).first()[0] == 2
    assert "3 sequences, lower bound 3" in caplog.text
