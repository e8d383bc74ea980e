"""Repeated passages across documents by collinear chaining of shared seeds.

Seeds. Of the hashes of each document's five-word shingles, winnowing keeps the smallest of every
``window`` consecutive ones, so any run of window + 4 equal words holds a common seed wherever it
stands. Each seed that several documents hold is joined to its first occurrence (smallest doc_id)
alone: a passage in n documents makes n matches, not n squared.

Chains. The matches of a document with an earlier one are swept in the order of their places; a
Fenwick tree over the places in the earlier document gives the best chain that ends before a
match, gaps costing in proportion to their length. Chains break at long gaps.

Alignment. The words around each chain are fetched from both documents and compared along its
diagonals; where the diagonal changes, the best changing point is taken. Runs with matches at +1
and other words at -4 (four in five words match at least) of ``least`` words or more are passages.

The rest. A seed's first holder need not hold the whole passage: its pieces may stand earlier in
several documents. So the windows of ``least`` words that could stand in an earlier document and
lie in no passage found so far are hashed whole, joined to their first holders, and aligned too.
A window stands in an earlier document only if that one has its inner seeds, so the windows to
look at, and the documents to look in, follow from the seeds that matched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, likely, remove_path, stored
from .words import gram_hashes, hashed, portions, sliding, stretch_hashes

SHINGLE = 5
WINDOW = 12
_GRID = 16  # windows are fetched in whole cells of so many words, at first
_GAP, _DRIFT, _COST = 96, 48, 0.05
_ROW = 1 << 32  # a row's number and a place in it as one number
_MANY = 1 << 18  # matches that are solved at once


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def winnow(h: np.ndarray, window: int = WINDOW, sizes: np.ndarray | None = None) -> np.ndarray:
    """Indices of the hashes that are the smallest of some ``window`` consecutive ones of their text, or of
    all if it has fewer; every such place, so each copy in one text has seeds. ``sizes``: how many of
    the hashes belong to each text (None: one text)."""
    sizes = np.array([len(h)]) if sizes is None else sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[row]
    at = np.arange(len(h)) + (window - 1) * row  # with room between the texts, so no window reaches into the next
    wide = np.full(len(h) + (window - 1) * (len(sizes) + 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    wide[at] = h
    low = sliding(wide, window, np.minimum)
    begins = at[(place == 0) | (place + window <= sizes[row])]
    minima = np.zeros(len(wide) + window - 1, dtype=np.uint64)
    minima[begins + window - 1] = low[begins]
    return np.flatnonzero(sliding(minima, window, np.maximum)[at] == h)


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, pos) of every document with an id and at least five words."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for first, texts in portions(b.column("text")):
                words, edges = hashed(texts, words_of)
                grams = gram_hashes(words, list(range(SHINGLE)))
                sizes = np.maximum(np.diff(edges) - (SHINGLE - 1), 0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                h = grams[edges[row] + place]
                at = winnow(h, sizes=sizes)
                yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(ids[first + row[at]]), pa.array(place[at].astype(np.int32))], ["h", "doc", "pos"])

    return _texts(docs, "doc_id").mapInArrow(run, "h long, doc long, pos int")


def _texts(docs: DataFrame, name: str) -> DataFrame:
    """The documents that take part, with their id under ``name``."""
    return docs.select(F.col("doc_id").cast("long").alias(name), "text").where(F.col(name).isNotNull() & F.col("text").isNotNull())


def thin(p: np.ndarray, r: np.ndarray, apart: int) -> np.ndarray:
    """Indices of the matches (p, r), p ascending, without those that only go on a periodic stretch: a
    match whose place r also matched one and two periods of up to ``apart`` words before stays only
    if the next one would be over ``apart`` words from the last that stays, or if it is the stretch's
    last. Places that recur without a period all stay. Stretches of ``apart`` words from the
    matches that stay cover those of all."""
    if len(np.unique(r)) == len(r):
        return np.arange(len(p))
    keep, seen = [], {}  # r: the last two places, the last that stays, the last that does not and came after it
    for i, (at, to) in enumerate(zip(p.tolist(), r.tolist(), strict=True)):
        one, two, kept, left = seen.get(to, (None, None, None, None))
        goes_on = two is not None and at - one == one - two and at - one <= apart
        if not goes_on and left is not None:
            keep.append(left)
        if not goes_on or at - kept + at - one > apart:
            keep.append(i)
            seen[to] = (at, one, at, None)
        else:
            seen[to] = (at, one, kept, i)
    return np.array(sorted([*keep, *(x[3] for x in seen.values() if x[3] is not None)]))


class Fenwick:
    """Prefix maxima of (value, index) over places 0 .. n-1."""

    def __init__(self, n: int):
        self.best = [(-1e300, -1)] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def below(self, place: int) -> tuple[float, int]:
        """The maximum over places smaller than ``place``."""
        out = (-1e300, -1)
        while place:
            out = max(out, self.best[place])
            place -= place & -place
        return out


def chains(p: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of matches (p, r), p ascending: index arrays, together all matches. A chain
    scores SHINGLE a match, less _COST for each word that its matches are apart in either text."""
    n = len(p)
    drift = np.diff(p - r)
    if n == 1 or not drift.any():
        order = [np.arange(n)]
    else:
        places = np.unique(r, return_inverse=True)[1]
        tree, score, back = Fenwick(int(places.max()) + 1), [0.0] * n, [-1] * n
        at, pl, rl = 0, p.tolist(), r.tolist()
        while at < n:
            end = at
            while end < n and pl[end] == pl[at]:
                end += 1
            for i in range(at, end):
                value, j = tree.below(int(places[i]))
                value -= _COST * (pl[i] + rl[i])
                score[i], back[i] = (SHINGLE + value, j) if value > 0 else (float(SHINGLE), -1)
            for i in range(at, end):
                tree.put(int(places[i]), (score[i] + _COST * (pl[i] + rl[i]), i))
            at = end
        order, taken = [], [False] * n
        for i in sorted(range(n), key=lambda i: -score[i]):
            chain = []
            while i >= 0 and not taken[i]:
                taken[i] = True
                chain.append(i)
                i = back[i]
            if chain:
                order.append(np.array(chain[::-1]))
    out = []
    for chain in order:
        dp, dr = np.diff(p[chain]), np.diff(r[chain])
        out += np.split(chain, np.flatnonzero((dp > _GAP) | (dr > _GAP) | (np.abs(dp - dr) > _DRIFT)) + 1)
    return out


def _cells(low: np.ndarray, high: np.ndarray, grid: int = _GRID) -> tuple[np.ndarray, np.ndarray]:
    """The words from ``low`` to ``high`` with at least ``grid`` more on either side, in whole cells."""
    return np.maximum(0, low - grid) // grid * grid, -(-(high + grid) // grid) * grid


def ranges(row: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): where windows of ``least`` words (38 or more) may begin whose inner seeds
    are all among the places, which ascend within each row; ascending and disjoint.

    Inner seeds are smallest in a run of hashes that the window holds whole, so every text with the
    window has them; they begin and end within WINDOW of the inner part's ends and are at most
    WINDOW apart."""
    if not len(places):
        return row, places, places
    edges = np.flatnonzero((np.diff(row) != 0) | (np.diff(places) > WINDOW)) + 1
    begin, end = np.r_[0, edges], np.r_[edges - 1, len(places) - 1]
    low = np.maximum(0, places[begin] - 2 * (WINDOW - 1))
    high = places[end] - least + SHINGLE + 2 * (WINDOW - 1)
    ok = high >= low
    return row[begin][ok], low[ok], high[ok]


def spread(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places from ``low`` to ``high``."""
    n = high - low + 1
    return np.repeat(row, n), np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)


def starts(places: np.ndarray, least: int) -> np.ndarray:
    """The places of :func:`ranges` in one text."""
    places = np.unique(places)
    return spread(*ranges(np.zeros(len(places), dtype=np.int64), places, least))[1]


def union(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of each row's spans, as ascending (row, place) numbers of their begins and ends."""
    order = np.lexsort((begin, row))
    low, high = row[order] * _ROW + begin[order], np.maximum.accumulate(row[order] * _ROW + end[order])
    new = np.flatnonzero(np.r_[np.ones(min(1, len(low)), dtype=bool), low[1:] > high[:-1]])
    return low[new], high[np.r_[new[1:] - 1, len(high) - 1]] if len(new) else high


def uncovered(row: np.ndarray, at: np.ndarray, spans: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """Which windows of ``least`` words from ``at`` do not lie in the unions of their rows' spans."""
    begin, end = spans
    if not len(begin):
        return np.ones(len(at), dtype=bool)
    key = row * _ROW + at
    i = np.searchsorted(begin, key, side="right") - 1
    return (i < 0) | (key + least > end[np.maximum(i, 0)])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """For each element of a column of lists the row that it is in, and the elements."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _union_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    row, spans = _flat(column)
    return union(row, *(spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end")))


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The values cut at ``begin`` into lists."""
    return pa.ListArray.from_arrays(pa.array(np.r_[begin, len(values)].astype(np.int32)), pa.array(values, kind))


_CHAIN = "doc long, other long, p array<int>, r array<int>, lo int, hi int, other_lo int, other_hi int, h array<long>"


def _chained(matches: DataFrame, least: int) -> DataFrame:
    """The chains of each document with each earlier one, and with a null ``other`` the places and
    hashes of its matches where windows may stand. A task holds one document's matches; those of
    periodic stretches are merged."""
    names = ["doc", "other", "p", "r", "lo", "hi", "other_lo", "other_hi", "h"]

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("doc", "other", "pos", "other_pos", "h")]))
            size += len(b)
            if size > _MANY and held[0][0, 0] != held[-1][0, -1]:
                now = np.concatenate(held, axis=1)
                last = int(np.searchsorted(now[0], now[0, -1]))  # sorted: the last document may go on
                yield from solve(now[:, :last])
                held, size = [now[:, last:]], now.shape[1] - last
        if size:
            yield from solve(np.concatenate(held, axis=1))

    def chained(doc, other, p, r, begin):
        end = np.r_[begin[1:], len(p)] - 1
        cells = (*_cells(p[begin], p[end] + SHINGLE), *_cells(r[begin], r[end] + SHINGLE))
        lists = [_lists(x, begin, pa.int32()) for x in (p, r)]
        return pa.record_batch([pa.array(doc), pa.array(other), *lists, *(pa.array(c, pa.int32()) for c in cells), pa.nulls(len(begin), pa.list_(pa.int64()))], names)

    def solve(now):
        doc, other, p, r, h = now
        first = np.r_[True, (np.diff(doc) != 0) | (np.diff(other) != 0)]
        edges = np.r_[np.flatnonzero(first), len(doc)]
        straight = np.minimum.reduceat(p - r, edges[:-1]) == np.maximum.reduceat(p - r, edges[:-1])
        # all matches of most pairs lie on one diagonal: their chains break at gaps alone
        on = np.flatnonzero(np.repeat(straight, np.diff(edges)))
        if len(on):
            begin = np.flatnonzero((first | np.r_[True, np.diff(p) > _GAP])[on])
            yield chained(doc[on][begin], other[on][begin], p[on], r[on], begin)
        found = []
        for g in np.flatnonzero(~straight).tolist():
            part = np.arange(edges[g], edges[g + 1])
            part = part[thin(p[part], r[part], least)]
            found += [part[chain] for chain in chains(p[part], r[part])]
        if found:
            at = np.concatenate(found)
            begin = np.cumsum([0, *(len(x) for x in found[:-1])])
            yield chained(doc[at][begin], other[at][begin], p[at], r[at], begin)
        order = np.lexsort((p, doc))
        whole = np.isin(doc, np.unique(ranges(doc[order], p[order], least)[0]))
        if whole.any():
            begin = np.flatnonzero(np.r_[True, np.diff(doc[whole]) != 0])
            none = [pa.nulls(len(begin), t) for t in (pa.list_(pa.int32()), *[pa.int32()] * 4)]
            yield pa.record_batch([pa.array(doc[whole][begin]), pa.nulls(len(begin), pa.int64()), _lists(p[whole], begin, pa.int32()), *none, _lists(h[whole], begin, pa.int64())], names)

    dealt = matches.repartition("doc").sortWithinPartitions("doc", "other", "pos", "other_pos")
    return dealt.mapInArrow(run, _CHAIN)


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the window ``a`` the place in the window ``b`` that it is aligned to along the
    chain of matches (p, r), and whether the words are equal."""
    n = len(a)

    def along(shift, low, high):
        to = np.arange(low, high) + shift
        inside = (to >= 0) & (to < len(b))
        same = np.zeros(high - low, dtype=bool)
        same[inside] = a[low:high][inside] == b[to[inside]]
        return to, same

    shifts = r - p
    turns = np.flatnonzero(np.diff(shifts)) + 1
    to, same = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
    begin = 0
    for t in turns.tolist():
        low, high = int(p[t - 1]), int(p[t])
        to[begin:low], same[begin:low] = along(shifts[t - 1], begin, low)
        (to1, one), (to2, two) = along(shifts[t - 1], low, high), along(shifts[t], low, high)
        cut = int(np.argmax(np.r_[0, np.cumsum(one)] + np.r_[np.cumsum(two[::-1])[::-1], 0]))
        to[low:high], same[low:high] = np.r_[to1[:cut], to2[cut:]], np.r_[one[:cut], two[cut:]]
        begin = high
    to[begin:], same[begin:] = along(shifts[-1], begin, n)
    return to, same


def best_run(same: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run with the largest sum of +1 for a match and -4 for another word in each part of ``same``
    between the ``edges`` (no part is empty): [start, end) in all of it."""
    n = np.diff(edges)
    part = np.repeat(np.arange(len(n)), n)
    total = np.cumsum(np.where(same, 1, -4))
    before = np.r_[0, total[:-1]]  # the sum up to a word; it may begin a run
    # a part's sums all lie below those of the one before, so running minima begin anew
    below = np.minimum.accumulate(before - part * (10 * len(same) + 10)) + part * (10 * len(same) + 10)
    gain = total - below
    best = np.maximum.reduceat(gain, edges[:-1])
    firsts = lambda hit: hit[np.r_[True, np.diff(part[hit]) != 0]]  # noqa: E731 - each part's first place
    last = firsts(np.flatnonzero(gain == best[part]))
    begin = firsts(np.flatnonzero(before == below[last][part]))
    return np.where(best > 0, begin, edges[:-1]), np.where(best > 0, last + 1, edges[:-1])


def runs(same: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, end): of each part of ``same`` between the ``edges`` the best run of at least
    ``least`` words, and those left and right of it in turn; starts and ends are places in ``same``."""
    hits = np.r_[0, np.cumsum(same)]
    part, low, high = np.arange(len(edges) - 1), edges[:-1], edges[1:]
    found = []
    while True:
        # over four in five words of a run match
        ok = (high - low >= least) & (5 * (hits[high] - hits[low]) > 4 * least)
        part, low, high = part[ok], low[ok], high[ok]
        if not len(part):
            break
        inner = np.r_[0, np.cumsum(high - low)]
        begin, end = best_run(same[spread(part, low, high - 1)[1]], inner)
        begin, end = begin - inner[:-1] + low, end - inner[:-1] + low
        long = end - begin >= least
        found.append((part[long], begin[long], end[long]))
        some = end > begin
        part = np.r_[part[some], part[some]]
        low, high = np.r_[low[some], end[some]], np.r_[begin[some], high[some]]
    out = [np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(3)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def _windows(docs: DataFrame, made: DataFrame) -> DataFrame:
    """(id, lo, hi, words): the words' hashes in the places that the chains ``made`` want, as far as the text goes."""
    wanted = made.select(F.col("doc").alias("id"), "lo", "hi").union(made.select("other", "other_lo", "other_hi"))
    per = wanted.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))  # a few per cell, however often wanted

    def run(batches):
        for b in batches:
            of, wanted = _flat(b.column("w"))
            lo, hi = (wanted.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            ids = b.column("id").to_numpy()
            for first, texts in portions(b.column("text")):
                words, edges = hashed(texts, words_of)
                mine = slice(*np.searchsorted(of, (first, first + len(texts))).tolist())
                begin, end = edges[of[mine] - first], edges[of[mine] - first + 1]
                at, to = np.minimum(begin + lo[mine], end), np.minimum(begin + hi[mine], end)
                data = words.astype("<u4")[spread(at, at, to - 1)[1]]
                places = pa.py_buffer((4 * np.r_[0, np.cumsum(to - at)]).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), len(at), [None, places, pa.py_buffer(data)])
                yield pa.record_batch([pa.array(ids[of[mine]]), pa.array(lo[mine], pa.int32()), pa.array(hi[mine], pa.int32()), column], ["id", "lo", "hi", "words"])

    # texts without a window stay where they are
    some = likely(_texts(docs, "id"), "id", wanted.select("id"), "_some").where("_some").drop("_some")
    return some.join(per.hint("merge"), "id").mapInArrow(run, "id long, lo int, hi int, words binary")


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, words, matches): passages of at least
    ``least`` words (38 or more) of a document that stand in one with a smaller doc_id, as places of words.

    The earlier document is the first that holds the passage's seeds or a window of ``least`` of its
    words; a passage that several documents share is reported for each but the first. Every window
    of ``least`` words that stands in an earlier document lies in reported passages. Texts without five words and null texts
    have no passages; rows with a null doc_id take no part; rows with equal doc_id are not compared
    with each other. Other columns are ignored; an empty table gives an empty result.
    """
    if least < 38:
        raise ValueError("a window of fewer than 38 words need not hold inner seeds")
    spark = docs.sparkSession
    found, seed_path = stored(seeds(docs), "seeds")
    matches, first_path = _matches(found)
    made, path = stored(_chained(matches.select("doc", "other", "pos", "other_pos", "h"), least), "chains")
    remove_path(spark, first_path)
    done = _passages(docs, made.where("other is not null").drop("h"), None, least)
    rest, held_path = _windows_left(docs, found, made.where("other is null").select("doc", "p", "h"), done, least)
    rest, rest_path = stored(rest, "rest")
    remove_path(spark, held_path)
    remove_path(spark, seed_path)
    remove_path(spark, path)
    again, first_path = _matches(rest)
    made, path = stored(_chained(again.where("open").select("doc", "other", "pos", "other_pos", "h"), least).where("other is not null"), "chains")
    remove_path(spark, rest_path)
    remove_path(spark, first_path)
    return done.union(_passages(docs, made.drop("h"), path, least)).distinct()


def _matches(found: DataFrame) -> tuple[DataFrame, str]:
    """Rows (h, doc, pos) with the first holder (other, other_pos) of their hash, if it is an earlier
    document, and the path of the table of first holders. As a table of its own it leaves the join
    free to split a hash that very many documents hold."""
    # document and place as one number: a minimum of structs would sort all seeds
    place = F.col("doc").cast("decimal(20,0)") * _ROW + F.col("pos")
    first = found.groupBy("h").agg(F.min(place).alias("f"), F.max("doc").alias("last"))
    first = first.withColumn("other_pos", F.pmod("f", F.lit(_ROW)).cast("int")).withColumn("other", ((F.col("f") - F.col("other_pos")) / _ROW).cast("long"))
    first, path = stored(first.where("other < last").select("h", "other", "other_pos"), "first")
    return found.join(first.hint("shuffle_hash"), "h").where("doc > other"), path


def _passages(docs: DataFrame, made: DataFrame, path: str | None, least: int) -> DataFrame:
    """The passages along the chains; their table at ``path`` goes, if one is given."""
    done, grid = None, _GRID
    while True:
        aligned = _aligned(docs, made, least)
        if path:
            remove_path(docs.sparkSession, path)
        part = aligned.where("not open").select(*_PASSAGE)
        done = part if done is None else done.union(part)
        more = aligned.where("open")
        if more.isEmpty():
            return done
        grid *= 16
        made, path = stored(_widened(more, grid), "chains")


def _windows_left(docs: DataFrame, found: DataFrame, places: DataFrame, done: DataFrame, least: int) -> tuple[DataFrame, str]:
    """(h, doc, pos, open): windows of ``least`` words that hold the seeds of windows in no passage
    yet; ``open`` tells those. And the path of a table that this reads."""
    spans = done.select(F.col("doc_id").alias("doc"), F.struct("start", "end").alias("s")).groupBy("doc").agg(F.collect_set("s").alias("spans"))

    def wanted(batches):
        for b in batches:
            row, p = _flat(b.column("p"))
            p, h = p.to_numpy().astype(np.int64), b.column("h").flatten().to_numpy()
            order = np.lexsort((p, row))
            of, at = spread(*ranges(row[order], p[order], least))
            open_ = uncovered(of, at, _union_of(b.column("spans")), least)
            key = of[open_] * _ROW + at[open_]
            # the first open window that has the place inside
            i = np.searchsorted(key, row * _ROW + np.maximum(0, p - (least - SHINGLE - WINDOW + 1)))
            inside = np.flatnonzero(i < len(key))
            inside = inside[key[i[inside]] <= row[inside] * _ROW + p[inside] - (WINDOW - 1)]
            yield pa.record_batch([pa.array(np.unique(h[inside]))], ["h"])

    hashed_, path = stored(places.join(spans, "doc", "left").select("p", "h", "spans").mapInArrow(wanted, "h long").distinct(), "open")
    some = likely(found, "h", hashed_, "_some").where("_some").drop("_some")
    held = some.join(hashed_, "h", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("p")).where(F.size("p") > 1).withColumnRenamed("doc", "id")
    held, held_path = stored(held.join(spans.withColumnRenamed("doc", "id"), "id", "left"), "held")
    remove_path(docs.sparkSession, path)

    def run(batches):
        for b in batches:
            of, p = _flat(b.column("p"))
            p = p.to_numpy().astype(np.int64)
            order = np.lexsort((p, of))
            of, at = spread(*ranges(of[order], p[order], least))
            open_ = uncovered(of, at, _union_of(b.column("spans")), least)
            ids = b.column("id").to_numpy()
            for first, texts in portions(b.column("text")):
                words, edges = hashed(texts, words_of)
                mine = slice(*np.searchsorted(of, (first, first + len(texts))).tolist())
                row, place = of[mine], at[mine]
                begin = edges[row - first] + place
                inside = begin + least <= edges[row - first + 1]
                h = stretch_hashes(words, begin[inside], least)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids[row[inside]]), pa.array(place[inside], pa.int32()), pa.array(open_[mine][inside])], ["h", "doc", "pos", "open"])

    rows = likely(_texts(docs, "id"), "id", held.select("id"), "_some").where("_some").drop("_some")
    rows = rows.join(held.hint("merge"), "id").select("id", "text", "p", "spans")
    return rows.mapInArrow(run, "h long, doc long, pos int, open boolean"), held_path


_PASSAGE = ("doc_id", "start", "end", "other_id", "other_start", "other_end", "words", "matches")


def _widened(more: DataFrame, grid: int) -> DataFrame:
    """The chains of runs that reached the edge of their windows, with windows in larger cells."""

    def cells(first, last):
        low = F.floor(F.greatest(F.lit(0), first - grid) / grid) * grid
        return low.cast("int"), (F.ceil((last + SHINGLE + grid) / grid) * grid).cast("int")

    chain = more.select(F.col("doc_id").alias("doc"), F.col("other_id").alias("other"), "p", "r")
    lo, hi = cells(F.element_at("p", 1), F.element_at("p", -1))
    other_lo, other_hi = cells(F.element_at("r", 1), F.element_at("r", -1))
    return chain.select("*", lo.alias("lo"), hi.alias("hi"), other_lo.alias("other_lo"), other_hi.alias("other_hi"))


def _aligned(docs: DataFrame, made: DataFrame, least: int) -> DataFrame:
    """As a table: the passages along each chain, or one row with ``open`` and the chain if one of its runs
    reaches the edge of a window and its text goes on."""
    windows, path = stored(_windows(docs, made), "windows")
    ours = windows.select(F.col("id").alias("doc"), "lo", "hi", F.col("words").alias("a"))
    theirs = windows.select(F.col("id").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("words").alias("b"))
    pairs = made.join(ours, ["doc", "lo", "hi"]).join(theirs, ["other", "other_lo", "other_hi"])
    taken = ["doc", "other", "lo", "hi", "other_lo", "other_hi", "p", "r", "a", "b"]

    def run(batches):
        for batch in batches:
            # windows may be long: so many rows at once that they hold about a million words
            words = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in "ab") // 4)
            edges = np.r_[0, np.flatnonzero(np.diff(words >> 20)) + 1, len(batch)]
            for at, to in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if to > at:
                    yield solve(batch.slice(at, to - at))

    def solve(b):
        doc, other, lo, hi, other_lo, other_hi = (b.column(c).to_numpy().astype(np.int64) for c in taken[:6])
        (row, p), (_, r) = (_flat(b.column(c)) for c in "pr")
        p, r = p.to_numpy().astype(np.int64) - lo[row], r.to_numpy().astype(np.int64) - other_lo[row]
        begin = np.r_[np.flatnonzero(np.r_[True, np.diff(row) != 0]), len(row)]
        na, nb = (pc.binary_length(b.column(c)).to_numpy().astype(np.int64) // 4 for c in "ab")
        a, other_words = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4") for c in "ab")
        edges, other_edges = np.r_[0, np.cumsum(na)], np.r_[0, np.cumsum(nb)]
        # along the first match's diagonal
        of, place = spread(np.arange(len(b)), np.zeros(len(b), dtype=np.int64), na - 1)
        to = place + (r - p)[begin[:-1]][of]
        inside = np.flatnonzero((to >= 0) & (to < nb[of]))
        same = np.zeros(len(to), dtype=bool)
        same[inside] = a[inside] == other_words[other_edges[of[inside]] + to[inside]]
        # a row of another text under the same id may be too short for the chain
        fits = (p[begin[1:] - 1] < na) & (np.maximum.reduceat(r, begin[:-1]) < nb)
        same &= fits[of]
        bent = fits & (np.minimum.reduceat(r - p, begin[:-1]) != np.maximum.reduceat(r - p, begin[:-1]))
        for i in np.flatnonzero(bent).tolist():
            own, chain = slice(edges[i], edges[i + 1]), slice(begin[i], begin[i + 1])
            to[own], same[own] = align(a[own], other_words[other_edges[i] : other_edges[i + 1]], p[chain], r[chain])
        of, start, end = runs(same, edges, min(least, WINDOW))
        hits = np.r_[0, np.cumsum(same)]
        s, e, to_s, to_e = start - edges[of], end - edges[of], to[start], to[end - 1]
        # a run that ends within a shingle of an edge may go on behind it, if the text does
        at_edge = (s < SHINGLE) & (lo[of] > 0) | (e > na[of] - SHINGLE) & (na == hi - lo)[of]
        at_edge |= (to_s < SHINGLE) & (other_lo[of] > 0) | (to_e >= nb[of] - SHINGLE) & (nb == other_hi - other_lo)[of]
        more = np.unique(of[at_edge])
        good = (e - s >= least) & ~np.isin(of, more)
        of = of[good]
        numbers = (doc[of], lo[of] + s[good], lo[of] + e[good], other[of], other_lo[of] + to_s[good], other_lo[of] + to_e[good] + 1, (e - s)[good], (hits[end] - hits[start])[good])
        none, i = pa.nulls(len(more), pa.int64()), pa.array(more)
        closed = [pa.array(x) for x in numbers] + [pa.array(np.zeros(len(of), dtype=bool)), *[pa.nulls(len(of), pa.list_(pa.int32()))] * 2]
        still = [pa.array(doc[more]), none, none, pa.array(other[more]), *[none] * 4, pa.array(np.ones(len(more), dtype=bool)), *(b.column(c).take(i).cast(pa.list_(pa.int32())) for c in "pr")]
        return pa.record_batch([pa.concat_arrays([x, y]) for x, y in zip(closed, still, strict=True)], [*_PASSAGE, "open", "p", "r"])

    schema = ", ".join(f"{c} long" for c in _PASSAGE) + ", open boolean, p array<int>, r array<int>"
    out, _ = stored(pairs.select(*taken).mapInArrow(run, schema), "aligned")
    remove_path(docs.sparkSession, path)
    return out


def cut_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages that :func:`repeated_passages` found: each stays in the first
    document that holds it. Rows left without a word go; n_chars, if there is one, follows. Rows
    without passages, also those with a null doc_id or text, stay as they are; most of them are not
    even shuffled. Extra columns are kept, whatever their names; an empty table gives an empty result."""
    key, spans_, some, new = (fresh(docs, x) for x in ("_id", "_spans", "_some", "_text"))
    kept = docs.columns
    spans = found.select(F.col("doc_id").alias(key), F.struct("start", "end").alias("s")).groupBy(key).agg(F.collect_set("s").alias(spans_))
    marked = likely(docs.withColumn(key, F.col("doc_id").cast("long")), key, found.select("doc_id"), some)

    def run(batches):
        for b in batches:
            at, cut = _flat(b.column(spans_))
            begin, end = (cut.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            edges = np.searchsorted(at, np.arange(len(b) + 1)).tolist()
            texts = []
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                own = slice(edges[i], edges[i + 1])
                texts.append(remove(text.as_py(), begin[own], end[own]) if text.is_valid and edges[i] < edges[i + 1] else None)
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*kept, new])

    joined = marked.where(F.col(some)).join(spans.hint("merge"), key, "left").drop(key, some)
    joined = joined.mapInArrow(run, T.StructType([*docs.schema]).add(new, "string"))
    hit = F.col(new).isNotNull()
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.char_length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    left = joined.where(~hit | (F.trim(new) != "")).select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
    return marked.where(~F.col(some)).select(*[F.col(f"`{c}`") for c in docs.columns]).union(left)


def remove(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """``text`` without the words from each ``begin`` up to its ``end``, and the white space after them."""
    data = np.frombuffer(text, dtype=np.uint8)
    space = (data == 32) | (data >= 9) & (data <= 13)
    places = np.flatnonzero(~space & np.r_[np.ones(min(1, len(data)), dtype=bool), space[:-1]])
    places = np.r_[places, len(text)]
    out, done = [], 0
    for i in np.argsort(begin, kind="stable").tolist():
        low, high = (int(places[min(int(x), len(places) - 1)]) for x in (begin[i], end[i]))
        out.append(text[done : max(done, low)])
        done = max(done, high)
    return b"".join([*out, text[done:]])
