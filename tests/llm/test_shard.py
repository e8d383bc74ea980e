import zlib

import numpy as np
import pytest

from veilspark.llm import shard


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    p = shard.permute(x, n, 3)
    assert sorted(p.tolist()) == list(range(n))
    assert (shard.permute(p, n, 3, back=True) == x).all()
    s, t = shard.place(x, n, 5, 3)
    assert (shard.row_at(s, t, n, 5, 3) == x).all()


def check(rows, got, shards):
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_documents(spark):
    rows = [(i, f"text {i} é") for i in range(300)] + [(7, "text 7 é"), (None, "a"), (None, None), (301, None), (302, ""), (303, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, shard int, slot string")
    got = shard.shard_documents(df, 24).collect()
    check(rows, got, 24)
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    again = shard.shard_documents(df.repartition(5), 24).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_few_rows_and_none(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard.shard_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    check([1], shard.shard_documents(one).collect(), 24)
