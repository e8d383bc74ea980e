"""Benchmark decontamination by spaced seeds.

A fixed mask selects some of the words in a window and ignores the others, so a substitution at an
ignored position leaves the seed's hash as it is. Hashes of the test items are joined with those
of the training texts at all positions under all masks; each hit fixes a diagonal (item, shift), on
which the texts are compared word by word: the best run with matches at +1 and substitutions at -4
(so at least four in five words of it match) is the overlap.

The test side is measured first. Up to ``slice_seeds`` seeds it is shipped to all tasks, where its
table answers the join; nothing is shuffled. A larger one is joined by shuffles on the hashes: a
bitmap of fixed size holds back the documents' seeds that no test item has, and only documents
with a hit move. Either way the documents are scanned once for their seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, likely
from .words import gram_hashes, hashed, hashes, plain_words, portions

#: Fixed masks: 1 takes part, 0 is ignored.
MASKS = ("1110110111", "1101011011", "1011101101", "1110010100110111")
#: Fixed masks that items too short for some of those have besides.
SHORT_MASKS = ("11011", "1111")
SHORTEST = 5
_LOSS = 4
_BITS = 26  # the bitmap of a large benchmark's seeds has two to this power bits


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _masks(n: int) -> list[str]:
    """The masks for an item of ``n`` words."""
    return [m for m in MASKS if len(m) <= n] + [m for m in SHORT_MASKS if n < max(map(len, MASKS))]


def overlap(same: np.ndarray) -> tuple[int, int]:
    """[start, end) of the run with the largest sum of +1 for a match and -4 for a mismatch."""
    total = np.cumsum(np.r_[0, np.where(same, 1, -_LOSS)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def longest(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The best run if it has ``least`` words; else, of the parts left and right of it in turn, the
    run of at least ``least`` words with the most matches."""
    best, todo = None, [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if high - low < least or 5 * np.count_nonzero(same[low:high]) <= 4 * least:  # over four in five words of a run match
            continue
        a, b = overlap(same[low:high])
        if b - a < least:
            todo += [(low, low + a), (low + b, high)] if b > a else []
            continue
        row = (int(np.count_nonzero(same[low + a : low + b])), -(low + a), low + b)
        best = max(best or row, row)
    return best and (-best[1], best[2])


def required(n: int, least: int) -> int:
    """Words of overlap that an item of ``n`` words needs: ``least``, or four fifths of a short one."""
    return min(least, -(-4 * n // 5))


def match(item: list[bytes], doc: list[bytes], shift: int, least: int) -> tuple[int, int, int, int] | None:
    """(matches, less the start in the document, start in the item, words) of the longest overlap along
    a diagonal, compared word by word; larger is better."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.fromiter((x == y for x, y in zip(item[a:b], doc[a + shift : b + shift], strict=True)), dtype=bool, count=b - a)
    if not (run := longest(same, required(len(item), least))):
        return None
    start, end = run
    return int(same[start:end].sum()), -(a + shift + start), a + start, end - start


def best_matches(doc: list[bytes], diagonals, items, least: int) -> list[tuple[int, int, int, int, int]]:
    """(item id, start in the document, start in the item, words, matches): the longest overlap with each
    item along the (item, shift) ``diagonals``. ``items``: item -> (id, words)."""
    best: dict[int, tuple] = {}
    for item, shift in diagonals:
        ident, words = items[item]
        if row := match(words, doc, shift, least):
            best[ident] = max(best.get(ident, row), row)
    return [(i, -d, at, n, m) for i, (m, d, at, n) in best.items()]


class Seeds:
    """Items with their seeds, sorted by hash, for each mask that any of them uses."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, text.split(b" ")) for i, text in items]
        by_mask: dict[str, list] = {}
        for at, (_, w) in enumerate(self.items):
            words = hashes(w)
            for mask in _masks(len(words)):
                h = gram_hashes(words, _offsets(mask))
                by_mask.setdefault(mask, []).append((h, np.full(len(h), at), np.arange(len(h))))
        self.seeds = {}
        for mask, parts in by_mask.items():
            h, item, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << 20, dtype=bool)  # most seeds of a document are told apart by 20 bits
            some[h >> np.uint64(44)] = True
            self.seeds[mask] = (h[order], item[order], pos[order], some)

    def diagonals(self, words: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, shift) of the hits in many texts whose word hashes lie end to end."""
        out = [np.empty((0, 3), dtype=np.int64)]
        for mask, (h, item, pos, some) in self.seeds.items():
            own = gram_hashes(words, _offsets(mask))
            at = np.flatnonzero(some[own >> np.uint64(44)])
            text = np.searchsorted(edges, at, side="right") - 1
            inside = at + len(mask) <= edges[text + 1]
            at, text = at[inside], text[inside]
            first, last = (np.searchsorted(h, own[at], side=x) for x in ("left", "right"))
            n = last - first
            to = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
            out.append(np.stack([np.repeat(text, n), item[to], np.repeat(at - edges[text], n) - pos[to]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def find(self, column: pa.Array, least: int):
        """(row, matches as of :func:`best_matches`) of each text of a column with an overlap."""
        for first, texts in portions(column):
            hits = self.diagonals(*hashed(texts, plain_words))
            edges = np.r_[np.flatnonzero(np.diff(hits[:, 0], prepend=-1)), len(hits)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                text = int(hits[a, 0])
                if found := best_matches(plain_words(texts[text]), hits[a:b, 1:].tolist(), self.items, least):
                    yield first + text, found


_FOUND = ("item_id", "doc_start", "item_start", "words", "matches")


def _batch(ids: pa.Array, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(_FOUND)
    return pa.record_batch([ids.take(pa.array(rows, pa.int64())), *columns], ["doc_id", *_FOUND])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, slice_seeds: int = 400_000) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, words, matches): the longest overlap of each
    document with each test item, in words, if it has ``least`` words or four fifths of the item.

    Items with equal words are one, under their smallest item_id; a null item_id counts as -1.
    Items of fewer than five words are too short to tell and match nothing. Null texts have no
    words. Repeated rows of documents are reported each. Other columns are ignored; if either
    table is empty, so is the result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _FOUND)
    items, held = _items(benchmark, slice_seeds)
    if held is None:
        return _joined(docs, items, least, schema)
    shipped = docs.sparkSession.sparkContext.broadcast(held)  # at most slice_seeds seeds

    def run(batches):
        seeds = Seeds(shipped.value)
        for b in batches:
            rows, out = [], []
            for row, found in seeds.find(b.column("text"), least):
                rows += [row] * len(found)
                out += found
            yield _batch(b.column("doc_id"), rows, out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 13, slice_seeds: int = 400_000) -> DataFrame:
    """The rows of ``docs`` without an overlap that :func:`contaminated` would report. Rows with a null
    text have none and stay, whatever their doc_id; repeated rows stay or go together. Extra
    columns are kept, whatever their names; if either table is empty, all rows stay."""
    items, held = _items(benchmark, slice_seeds)
    if held is None:
        # doc_id need not tell rows apart: a row's text does
        key = fresh(docs, "_key")
        texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
        gone = cut(_joined(texts, items, least, "doc_id long, " + ", ".join(f"{c} long" for c in _FOUND)).select("doc_id").distinct())
        some = fresh(docs, "_some")
        marked = likely(docs.withColumn(key, F.xxhash64("text")), key, gone, some)
        few = marked.where(F.col(some)).join(gone.withColumnRenamed("doc_id", f"{key}_gone").hint("merge"), F.col(key) == F.col(f"{key}_gone"), "left_anti")
        return marked.where(~F.col(some)).union(few).drop(key, some)
    shipped = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        seeds = Seeds(shipped.value)
        for b in batches:
            found = np.ones(len(b), dtype=bool)
            found[[row for row, _ in seeds.find(b.column("text"), least)]] = False
            yield b.filter(pa.array(found))

    return docs.mapInArrow(run, docs.schema)


def _items(benchmark: DataFrame, slice_seeds: int) -> tuple[DataFrame, list[tuple[int, bytes]] | None]:
    """The items (item_id, words: joined by blanks), equal ones once, and their rows if they have no more seeds than that."""

    def tokens(batches):
        for b in batches:
            words = [plain_words(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            yield pa.record_batch([b.column("item_id"), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())], ["item_id", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").mapInArrow(tokens, "item_id long, words binary, n long")
    items = cut(items.where(F.col("n") >= SHORTEST).groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n")))
    seeds = (items.agg(F.sum("n")).first()[0] or 0) * len(MASKS)
    if seeds > slice_seeds:
        return items, None
    return items, sorted((r.item_id, bytes(r.words)) for r in items.collect())


def _joined(docs: DataFrame, items: DataFrame, least: int, schema: str) -> DataFrame:
    """:func:`contaminated` by a join of the test items' hashes with the documents'."""

    def item_seeds(batches):
        for b in batches:
            for words, text in zip(map(lambda t: t.as_py().split(b" "), b.column("words")), b.column("words"), strict=True):
                h = hashes(words)
                for mask in _masks(len(words)):
                    own = gram_hashes(h, _offsets(mask))
                    yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(np.arange(len(own))), pa.array([text.as_py()] * len(own), pa.binary())], ["h", "pos", "words"])

    tests = cut(items.mapInArrow(item_seeds, "h long, pos long, words binary"))
    # one bit for each value of the hash's upper bits: at most 2^_BITS / 64 rows reach the driver
    bit = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - _BITS))
    marks = tests.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(b % 64 AS INT)))").alias("m")).collect()
    table = np.zeros((1 << _BITS) // 64, dtype=np.int64)
    table[[r.w for r in marks]] = [r.m for r in marks]
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    masks = [*MASKS, *SHORT_MASKS]

    def doc_seeds(batches):
        bits = np.unpackbits(shipped.value.astype("<i8").view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            keys = b.column("key").to_numpy()
            for first, texts in portions(b.column("text")):
                words, edges = hashed(texts, plain_words)
                for mask in masks:
                    own = gram_hashes(words, _offsets(mask))
                    at = np.flatnonzero(bits[own >> np.uint64(64 - _BITS)])
                    text = np.searchsorted(edges, at, side="right") - 1
                    inside = at + len(mask) <= edges[text + 1]
                    at, text = at[inside], text[inside]
                    yield pa.record_batch([pa.array(keys[first + text]), pa.array(own[at].view(np.int64)), pa.array(at - edges[text])], ["key", "h", "at"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("text is not null")
    hits = texts.select("key", "text").mapInArrow(doc_seeds, "key long, h long, at long")
    diagonals = hits.join(tests, "h").select("key", "words", (F.col("at") - F.col("pos")).alias("shift")).distinct()
    named = cut(diagonals.join(items.select("words", "item_id"), "words").groupBy("key", "item_id", "words").agg(F.collect_list("shift").alias("shifts")))
    some = likely(texts, "key", named.select("key"), "_some").where("_some").drop("_some")
    per = named.groupBy("key").agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("items"))

    def verify(batches):
        for b in batches:
            rows, out = [], []
            for row, (text, items) in enumerate(zip(b.column("text").cast(pa.binary()), b.column("items").to_pylist(), strict=True)):
                held = [(x["item_id"], x["words"].split(b" ")) for x in items]
                diagonals = [(i, shift) for i, x in enumerate(items) for shift in x["shifts"]]
                found = best_matches(plain_words(text.as_py()), diagonals, held, least)
                rows += [row] * len(found)
                out += found
            yield _batch(b.column("doc_id"), rows, out)

    return some.join(per.hint("merge"), "key").select("doc_id", "text", "items").mapInArrow(verify, schema)
