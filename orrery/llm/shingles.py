"""Sets of hashed word runs, as sorted 64-bit arrays."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.terms import terms

#: Bits of a part of a filter of asked keys, and of the whole filter at most; it only spares rows, results are exact.
PART, FILTER = 1 << 15, 1 << 27

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> _SHIFT)) * _A
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> _SHIFT)


class Hasher:
    """64-bit hashes of terms, with a bounded memory for frequent ones."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` consecutive terms."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = mix(hashes[:n])
    for i in range(1, width):
        found = mix(found * _B + hashes[i : i + n])
    return found


def shingle_set(text: str, width: int, hasher: Hasher, least_terms: int = 0) -> np.ndarray | None:
    """The sorted distinct runs of a text; None if it has fewer than least_terms terms."""
    words = terms(text)
    if len(words) < max(least_terms, width):
        return None
    return np.unique(runs_of(hasher(words), width))


def batch_sets(texts: list[str | None], width: int, hasher: Hasher, least_terms: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tokens, first): the distinct runs of many texts at once, sorted by row and token.

    Rows whose text has fewer than max(least_terms, width) terms, or is null, have none; first marks where
    a row begins. Runs over the edge of two texts are left out.
    """
    lists = [terms(t) if t is not None else [] for t in texts]
    length = np.array([len(x) if len(x) >= max(least_terms, width) else 0 for x in lists], dtype=np.int64)
    hashes = hasher([w for x, n in zip(lists, length, strict=True) if n for w in x])
    row = np.repeat(np.arange(len(lists)), length)
    found = runs_of(hashes, width)
    if not len(found):
        return np.empty(0, np.int64), found, np.empty(0, np.int64)
    whole = row[: len(found)] == row[width - 1 :]
    row, found = row[: len(found)][whole], found[whole]
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    return row, found, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))


def bit_filter(asked: DataFrame, most: int = FILTER, each: int = 16) -> np.ndarray:
    """A bit filter of asked(key BIGINT), of `each` bits a key up to `most`."""
    size = max(PART, min(most, 1 << (each * asked.count()).bit_length()))
    at = asked.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(PART - 1))).alias("bits"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in parts.collect():  # at most FILTER / PART rows of PART bits
        bits[row.part * PART // 8 : (row.part + 1) * PART // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys pass the filter."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
