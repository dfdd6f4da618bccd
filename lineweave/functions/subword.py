"""Hashed sub-word features of texts, computed once a word: each word weighs 2, each 3- and 4-gram of the padded word 1."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np

#: Buckets of the features, and how many of the heaviest a block keeps.
DIMS, KEEP = 4096, 256
_WORD = re.compile("[a-z0-9_]+")


class SubwordFeatures:
    """Features of case-folded texts; remembers words within a bound."""

    LIMIT = 200_000

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def word(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights of a word."""
        if (found := self.known.get(w)) is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            padded = f"#{w}#"
            tokens = [f"w:{w}", *(f"c:{padded[i : i + n]}" for n in (3, 4) for i in range(len(padded) - n + 1))]
            buckets = np.array([crc32(t.encode()) % self.dims for t in tokens], dtype=np.int64)
            weights = np.ones(len(tokens))
            weights[0] = 2.0
            found = self.known[w] = (buckets, weights)
        return found

    def words(self, folded: str) -> list[str]:
        """The words of a text, as often as they occur."""
        return _WORD.findall(folded)

    def _summed(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in order and their weights of words so often."""
        found = [self.word(w) for w in counts]
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0)
        out = np.bincount(np.concatenate([b for b, _ in found]), np.concatenate([x * n for (_, x), n in zip(found, counts.values())]), self.dims)
        at = np.flatnonzero(out)
        return at, out[at]

    def length(self, words: list[str]) -> float:
        """The length of the words' vector before it is normalised."""
        _, x = self._summed(Counter(words))
        return float(np.sqrt((x * x).sum()))

    def sparse(self, folded: str, keep: int | None = KEEP) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and normalised weights of the text; only the ``keep`` heaviest features stay, ties by bucket."""
        at, x = self._summed(Counter(_WORD.findall(folded)))
        if keep is not None and len(at) > keep:
            order = np.sort(np.lexsort((at, -x))[:keep])
            at, x = at[order], x[order]
        return at, x / (np.sqrt((x * x).sum()) or 1.0)

    def dense(self, folded: str, keep: int | None = KEEP) -> np.ndarray:
        """Normalised vector of the text by ``sparse``."""
        out = np.zeros(self.dims)
        at, x = self.sparse(folded, keep)
        out[at] = x
        return out
