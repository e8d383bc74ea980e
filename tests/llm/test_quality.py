import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality.classify(docs, labels.where(~held), F.col("source"), F.col("lang"), sample=20_000)
    rows = got.join(labels.where(held), "doc_id").select("doc_id", got["quality"].alias("p"), got["toxic"].alias("t"), "keep", labels["quality"].alias("y"), labels["toxic"].alias("z")).collect()
    assert len(rows) > 700
    assert np.mean([(r.p >= 0.5) == (r.y == 1) for r in rows]) > 0.9
    toxic = [r for r in rows if r.z]
    clean = [r for r in rows if not r.z and r.y]
    assert np.mean([r.t >= 0.5 for r in toxic]) > 0.75
    assert np.mean([r.keep for r in clean]) > 0.95


def test_sparse_sites_shrink(spark):
    rows = [(i, f"text number {i}", "big", "p") for i in range(200)] + [(300 + i, "word", f"bad{i % 5}", None) for i in range(100)] + [(500, "word", "tiny", "q"), (501, None, None, None), (None, "x", "tiny", "r")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, h string, p string, quality int, host string")
    labels = spark.createDataFrame([(i, int(i < 190), 0, "x") for i in range(200)] + [(300 + i, int(i // 5 % 10 == 0), 0, "x") for i in range(100)] + [(500, 0, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in quality.classify(docs, labels, F.col("h"), F.col("p")).collect()}
    assert len(got) == 303
    assert got[0].path_quality > 0.9 and got[300].path_quality < 0.3
    assert got[300].path_quality < got[500].path_quality < got[0].path_quality  # one bad label is little evidence
    assert all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got.values())


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "h"), (2, None, None)], "doc_id long, text string, h string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and abs(r.quality - 0.5) < 1e-9 for r in quality.classify(docs, none, F.col("h"), F.col("h")).collect())
    assert quality.classify(docs.limit(0), none, F.col("h"), F.col("h")).count() == 0


def test_features_of_odd_texts():
    for t in (b"", b" \n", "é".encode(), b"A" * 200_000):
        f = quality.features(t)
        assert (np.diff(f) > 0).all() and f.max() < quality.FEATURES


def test_posteriors_against_plain_python(spark):
    """Counts, rates, concentrations and posteriors of the hierarchy from the classifier's evidence alone."""
    import math
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    texts = ["good solid prose here", "buy now cheap", "plain words follow", "hate and more hate", None, ""]
    rows = [(i, rnd.choice(texts), f"h{min(5, int(rnd.expovariate(0.4)))}", rnd.choice(["p", "q", None])) for i in range(400)]
    rows += [(7, rows[7][1], "h0", "p"), (None, texts[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p string")
    labels = spark.createDataFrame([(i, int(rnd.random() < 0.2 + 0.1 * int(rows[i][2][1])), int(rnd.random() < 0.1)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, quality.classify(docs, labels, F.col("h"), F.col("p")).collect()), key=str)
    known = quality._labels(labels)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    seen = [r.asDict() for r in quality.evidence(docs.select("doc_id", "text", key(F.col("h")).alias("host"), key(F.col("p")).alias("path")), *quality.train(docs, known)).collect()]
    told = {r["_label_id"]: r for r in known.collect()}
    sigmoid, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    for t in quality.TARGETS:
        values = [r[t] for r in told.values() if r[t] is not None]
        prior = (sum(values) + 0.5) / (len(values) + 1)
        paths, hosts = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
        for r in seen:
            y = told[r["doc_id"]][t] if r["doc_id"] in told else None
            r["n"] = 1.0 if y is not None else 0.25
            r["k"] = float(y) if y is not None else 0.25 * sigmoid(r[f"llr_{t}"] + logit(prior))
            for table, at in ((paths, (r["host"], r["path"])), (hosts, r["host"])):
                table[at][0] += r["n"]
                table[at][1] += r["k"]

        def worth(groups, parent):
            parents = defaultdict(list)
            for at, (n, k) in groups.items():
                parents[parent(at)].append((n, k))
            g, total = len(groups), sum(n for n, _ in groups.values())
            between = sum(n * (k / n - sum(x[1] for x in members) / sum(x[0] for x in members)) ** 2 for members in parents.values() for n, k in members) / (g - len(parents))
            inside = sum(k - k * k / n for n, k in groups.values()) / (total - g)
            size = (total - sum(sum(n * n for n, _ in m) / sum(n for n, _ in m) for m in parents.values())) / (g - len(parents))
            if between <= inside:
                return 1e6
            rho = (between - inside) / (between + (size - 1) * inside)
            return min(1e6, max(1.0, (1 - rho) / rho))

        a, b = worth(hosts, lambda _: 0), worth(paths, lambda at: at[0])
        base = (sum(k for _, k in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)

        def rates(r, n, k):
            host = (hosts[r["host"]][1] - k + a * base) / (hosts[r["host"]][0] - n + a)
            return host, (paths[r["host"], r["path"]][1] - k + b * host) / (paths[r["host"], r["path"]][0] - n + b)

        for r in seen:
            r[f"host_{t}"], r[f"path_{t}"] = rates(r, 0, 0)
            r[f"post_{t}"] = sigmoid(r[f"llr_{t}"] + logit(rates(r, r["n"], r["k"])[1]))
    want = sorted(((r["doc_id"], 1 - r["post_low"], r["post_toxic"], 1 - r["host_low"], 1 - r["path_low"], r["host_toxic"], r["path_toxic"], r["post_low"] <= 0.5 and r["post_toxic"] < 0.5) for r in seen), key=str)
    assert len(got) == len(want) == 402
    for x, y in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert x[0] == y[0] and np.allclose(x[1:7], y[1:7], atol=1e-6) and x[7] == y[7]


def test_a_sparse_path_is_drawn_to_its_host(spark):
    """Spread between hosts is no spread of paths: with hosts far apart and paths alike, a path of one
    row keeps its host's rate."""
    rows = [(1000 * h + i, "same words", f"h{h}", f"p{i % 4}") for h in range(6) for i in range(80)] + [(9999, "same words", "h5", "rare")]
    labels = [(1000 * h + i, int(i // 4 % 10 < (9 if h % 2 else 1)), 0) for h in range(6) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p string")
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("h"), F.col("p")).collect()}
    assert got[9999].path_quality > 0.8 and abs(got[9999].path_quality - got[9999].host_quality) < 0.05
    assert got[0].host_quality < 0.2
