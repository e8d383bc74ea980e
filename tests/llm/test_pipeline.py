import random

import corpus_pipeline
import pytest
from test_simhash import shingles
from tokenizers import Tokenizer

from veilspark.llm import decontaminate, passages
from veilspark.llm.words import plain_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table with a case for each stage."""
    at = tmp_path_factory.mktemp("tables")
    rnd = random.Random(8)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").orderBy("doc_id").limit(120).collect()
    rows = [tuple(r) for r in base]
    shared = " ".join(f"sh{rnd.randrange(10**6)}" for _ in range(70))
    items = [(1, " ".join(f"it{rnd.randrange(10**6)}" for _ in range(20)))]
    rows += [(1000 + i, f"{rows[i][1]} {shared} closing words {i}", rows[i][2], "s", 1) for i in range(6)]
    mixed = rows[9][1].split()
    rnd.shuffle(mixed)
    rows += [(1100, f"{' '.join(mixed)} {items[0][1]} end", "en", "s", 1)]
    rows += [(1200, None, None, None, None), (1201, "12 34 !!", "en", "s", 1), (None, rows[3][1], None, None, None), (1202, rows[4][1], "en", "s", 1)]
    rows += [(1202, rows[4][1], "en", "s", 1), (None, "zu und der die " * 5, None, None, None), (None, "zu und der die " * 5, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder))
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [tuple(r) for r in docs.collect()]
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    first = kept["language"]
    assert sorted(map(str, first)) == sorted(str(r) for r in given if r[1] and any(c.isalpha() for c in r[1]))

    second = kept["near_duplicates"]
    texts = {r[0]: r[1] for r in first if r[0] is not None}
    grams = {d: shingles(t) for d, t in texts.items()}
    alike = lambda x, y: sum((grams[x] & grams[y]).values()) / sum((grams[x] | grams[y]).values())
    ids = {r[0] for r in second if r[0] is not None}
    assert set(second) <= set(first) and len(ids) == sum(r[0] is not None for r in second)
    assert all(alike(x, y) < 0.9 for x in ids for y in ids if x < y and grams[x].keys() & grams[y].keys())
    for d in texts.keys() - ids:  # each has a smaller one like it
        assert max(alike(d, x) for x in texts if x < d and grams[x].keys() & grams[d].keys()) > 0.75
    assert sum(r[0] is None for r in second) == 1

    third = {r[0]: r for r in kept["repeated_passages"]}
    words = {r[0]: passages.words_of(r[1].encode()) for r in second if r[0] is not None}
    for d, r in third.items():
        if d is None:
            continue
        own = words[d]
        later = [w for w in words if w < d and any(own[i : i + 50] == words[w][j : j + 50] for i in range(len(own) - 49) for j in range(len(words[w]) - 49) if own[i] == words[w][j])]
        if not later and r[1] != next(x[1] for x in second if x[0] == d):
            # a fuzzy passage: five words of it at least stand in an earlier document
            grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            assert any(tuple(words[w][j : j + 5]) in grams for w in words if w < d for j in range(len(words[w]) - 4))
        if later:
            assert len(r[1]) < len(next(x[1] for x in second if x[0] == d))
    holders = [d for d, r in third.items() if "sh" in r[1] and sum(w.startswith("sh") and w[2:].isdigit() for w in r[1].split()) >= 50]
    assert len(holders) == 1

    item = plain_words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text.encode())
    clean = kept["benchmark_passages"]
    bad = [r[0] for r in kept["repeated_passages"] if any(plain_words(r[1].encode())[i : i + 13] == item[j : j + 13] for j in range(8) for i in range(len(r[1].split())))]
    assert 1100 in bad and sorted(str(r) for r in clean) == sorted(str(r) for r in kept["repeated_passages"] if r[0] not in bad)
    assert decontaminate.required(20, 13) == 13


def test_run(spark, folder):
    import public_tokenizers

    out = corpus_pipeline.run(spark, str(folder)).collect()
    docs = spark.read.parquet(f"{folder}/benchmark_passages").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in out) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
