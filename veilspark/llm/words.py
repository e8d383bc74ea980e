"""Words of a text as numbers, for the operators on word sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased, split at everything in ASCII but letters and
    digits."""
    return text.translate(_PLAIN).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each word, as unsigned 64-bit numbers."""
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def hashed(texts: list[bytes], split: Callable[[bytes], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of many texts end to end, and where each text's words begin (and the
    last one's end)."""
    lists = [split(t) for t in texts]
    edges = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
    return np.fromiter(map(zlib.crc32, chain.from_iterable(lists)), np.uint64, int(edges[-1])), edges


def portions(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a column of texts, in runs of about ``most`` bytes; nulls are empty."""
    first, held, size = 0, [], 0
    for text in texts.cast(pa.binary()):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums of products."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, offsets: list[int], seed: int = 3) -> np.ndarray:
    """A 64-bit hash of the words at ``offsets`` from each position at which all of them exist."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for o, m in zip(offsets, multipliers(offsets[-1] + 1, seed)[offsets], strict=True):
        total += words[o : o + n] * m
    return scramble(total)


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` consecutive elements."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = of(x[:-step], x[step:])
        reach += step
    return x


def stretch_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place of ``at``: differences of the running sum
    of a polynomial, whose odd base has an inverse."""
    base = int(multipliers(1, 9)[0])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(words), base, dtype=np.uint64)], dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(words), pow(base, -1, 1 << 64), dtype=np.uint64)], dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(scramble(words + np.uint64(1)) * powers[:-1], dtype=np.uint64)]
    return scramble((total[at + width] - total[at]) * inverse[at])
