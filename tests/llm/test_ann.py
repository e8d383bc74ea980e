import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import ann


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            scores = sorted((-float((q * v).sum()), int(j)) for j, v in zip(ids, x, strict=True) if j != i)
            out[int(i)] = [(j, -s) for s, j in scores[:k]]
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) / max(1, len(w)) for q, w in want.items()])


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.where("embedding is not null").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = collect(ann.nearest(df, F.col("id") % 20 == 0, region=150, first_round=2))
    want = brute(ids, x, 20)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        exact = dict(brute_scores(ids, x, q))
        assert all(abs(exact[j] - s) < 1e-12 for j, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_recall_with_the_parameters_of_the_query(spark):
    from veilspark.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = collect(queries.op2_ann(spark, "/root/testdata/sf0.1"))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0} and recall(got, brute(ids, x, 20)) >= 0.9


def brute_scores(ids, x, q):
    v = x[list(ids).index(q)]
    return [(int(j), float((v * w).sum())) for j, w in zip(ids, x, strict=True)]


def test_odd_vectors_and_ties(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(20, 80)] + [(0, same), (100, [0.0] * 3), (101, None), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, []), (None, same), (120, [3.0, 1.0]), (121, [1.0, 1.0]), (122, [2.0, 9.0]), (21, same)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    got = collect(ann.nearest(df, F.col("id") % 20 == 0))
    assert set(got) == {0, 20, 40, 60, 120}
    assert [j for j, _ in got[0]] == list(range(20, 40))
    assert [j for j, _ in got[20]] == [0, *range(21, 40)]
    assert got[120] == [(122, 15.0), (121, 4.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, F.col("id") % 20 == 0).count() == 0


def test_clusters_are_not_compared_with_all(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((30, 16)) * 8
    x = np.concatenate([c + rnd.standard_normal((100, 16)) for c in centres])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    report = {}
    got = collect(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, region=100, first_round=2, report=report))
    assert report["pairs"] == 3000 * 150 and report["computed"] < 0.5 * report["pairs"]
    assert recall(got, brute(np.arange(3000), x, 20)) >= 0.9


def test_every_point_lies_in_its_leaf():
    points = np.random.default_rng(2).standard_normal((5000, 3))
    points[:2000] = points[0]  # many equal ones
    tree = ann.top_tree(points[::3], 16)
    at = ann.route(tree, points)
    assert set(at.tolist()) == {n[1] for n in tree if n[0] < 0} and 8 <= at.max() + 1 <= 16
    assert len(set(at[:2000].tolist())) == 1
    assert ann.route(ann.top_tree(points[:0], 5), points).tolist() == [0] * 5000


def test_chi_square():
    rnd = np.random.default_rng(0)
    sample = (rnd.standard_normal((40000, 6)) ** 2).sum(axis=1)
    for x in (1.0, 5.0, 12.0):
        assert abs((sample <= x).mean() - ann.chi_square(np.array(x), 6)) < 0.01
