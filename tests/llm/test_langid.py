import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = total = 0
    for r in docs.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id].held_out == held
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
        elif held and r.lang:
            right += got[r.doc_id].lang_pred == r.lang
            total += 1
        assert 0 <= got[r.doc_id].score <= 1
    assert right >= 0.97 * total


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and n_chars > 800")
    langs, table = langid.model(docs)
    long = {x: next(r.text for r in docs.where(F.col("lang") == x).limit(1).collect()) for x in ("en", "de")}
    mixed = langid.trigrams(long["en"][:600] + " " + long["de"][:200])
    chosen, foreign = langid.infer([mixed, langid.trigrams("qxzj vvkq wxqz " * 20), langid.trigrams(long["de"])], table, len(langs))
    share = dict(zip(langs, chosen[0].tolist(), strict=True))
    assert 0.5 < share["en"] < 0.9 and 0.1 < share["de"] < 0.5 and share["en"] + share["de"] > 0.95
    assert foreign[0] < 0.2 and foreign[1] > 0.5
    assert chosen[2].tolist() == [float(x == "de") for x in langs]


def plain_mixture(p, n, pi, steps=20_000):
    """Expectation-maximisation one document at a time, to the end."""
    for _ in range(steps):
        new = [0.0] * len(pi)
        for row, c in zip(p, n, strict=True):
            whole = sum(a * b for a, b in zip(row, pi, strict=True))
            for j, a in enumerate(row):
                new[j] += c * a * pi[j] / whole
        new = [x / sum(n) for x in new]
        moved = max(abs(a - b) for a, b in zip(new, pi, strict=True))
        pi = new
        if moved < 1e-9:
            break
    return pi


def likelihood(p, n, pi):
    return sum(c * math.log(max(1e-300, sum(a * b for a, b in zip(row, pi, strict=True)))) for row, c in zip(p, n, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_sets_against_plain_expectation_maximisation(seed):
    """Proportions and sets as those of slow code that tries all nested sets."""
    rnd = np.random.default_rng(seed)
    table = rnd.dirichlet(np.full(40, 0.3), 3).T + 1e-4
    table = np.c_[table / table.sum(axis=0), np.full(40, 1 / 40)].astype(np.float32)
    docs = []
    for _ in range(12):
        true = rnd.dirichlet([0.4] * 3)
        docs.append(rnd.choice(40, rnd.integers(30, 400), p=(table[:, :3] @ true) / (table[:, :3] @ true).sum()))
    chosen, foreign = langid.infer(docs, table, 3)
    for doc, got, none in zip(docs, chosen, foreign, strict=True):
        f, n = np.unique(doc, return_counts=True)
        p = table[f].astype(float).tolist()
        first = plain_mixture(p, n.tolist(), [0.25] * 4)
        assert abs(first[3] - none) < 0.05
        ranks = sorted(range(3), key=lambda j: -first[j])
        best = None
        for size in (1, 2, 3):
            own = ranks[:size]
            q = [[row[j] for j in own] for row in p]
            pi = plain_mixture(q, n.tolist(), [1 / size] * size)
            value = likelihood(q, n.tolist(), pi) - 0.5 * (size - 1) * math.log(len(doc))
            options = (value, dict(zip(own, pi, strict=True)))
            best = max(best or options, options, key=lambda x: x[0])
            if {j for j in range(3) if got[j] > 0} == set(own):
                mine = value
                assert all(abs(got[j] - x) < 0.05 for j, x in zip(own, pi, strict=True))
        assert mine >= best[0] - 0.5  # the same set, or one as likely


def test_counts_against_plain_counting(spark):
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choices(["the", "Katze", "é\u0301t\u00e9", "42", "chat!"], k=rnd.randrange(30))), rnd.choice(["x", "y", None])) for _ in range(60)]
    rows += [(None, "x"), ("", "y")]
    want = {}
    for t, x in rows:
        for g in langid.trigrams(t or "") if x else ():
            want[x, int(g)] = want.get((x, int(g)), 0) + 1
    got = {(r.lang, r.bucket): r.n for r in langid.count(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat", "en"), (None, "le chat", "fr"), (5, "le chien", None), (4, "the cat", "en"), (6, "\U0001d400 ÀÉ " * 9000, "fr")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, _text int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert {r.lang_pred for r in got} <= {"und", "en", "fr"}
    assert all(abs(sum(x.share for x in r.languages) - 1) < 1e-5 and r.languages[0].lang == r.lang_pred for r in got if r.languages)
    df = df.withColumnRenamed("_text", "_own_score").withColumn("Languages", F.lit(3))
    assert langid.keep_known(df).columns == df.columns


def test_empty_and_unlabelled(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
