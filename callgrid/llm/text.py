"""Text rules that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.runtime import by_value

by_value(__name__)

#: ASCII blanks, as the contracts of the operators define them.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of runs of non-blanks; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate a column once and use it several times inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to ``most`` words of at most 64 bytes, so in tens of MB; longer words
    are hashed each time."""

    def __init__(self, most: int = 250_000):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the text's words in order. On bytes, lower() and split() know ASCII letters and blanks only."""
        if len(self) > self.most:
            self.clear()
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
