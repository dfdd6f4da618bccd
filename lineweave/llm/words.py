"""Word hashes and n-gram hashes shared by the operators that work on word shingles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multiplier of the rolling n-gram hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, computed once a process for as long as the table stays under a fixed size."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours, as signed 64-bit numbers."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bitmap(df: DataFrame, slot: Column, bits: int) -> bytes:
    """The slots (0 to ``bits`` - 1) that occur in ``df`` as a bit set of fixed size, built map-side; bit i is bit i % 8 of byte i // 8."""
    unit = 32_768
    n = df.select((slot + 1).alias("n"))
    rows = n.groupBy(F.bitmap_bucket_number("n").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("b"))
    out = bytearray(max(bits, unit) // 8)
    for r in rows.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        out[(r.k - 1) * unit // 8 : r.k * unit // 8] = r.b
    return bytes(out)


def has_bit(filled: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of ``slots`` (uint64) are set in a bit set of bytes."""
    return (filled[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
