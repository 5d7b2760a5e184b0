"""Character n-grams of many words at once, as arrays.

Words are joined by single blanks, which stand for the ends of words; a gram
may begin or end with a blank but not hold one inside.  A gram's id is a
polynomial of its code points modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import regex

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Runs of letters, in any script; fractions, raised digits and Roman numerals are none.
LETTERS = regex.compile(r"\p{L}+")


class WordGrams:
    """Code points of a list of words without blanks, and ids of their grams."""

    def __init__(self, words: Sequence[str]):
        text = " " + " ".join(words) + " "
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.blank = self.codes == 32
        at = np.arange(len(self.codes))
        before = np.maximum.accumulate(np.where(self.blank, at, -1))
        self.last_blank = np.concatenate(([-1], before[:-1]))  # the last blank strictly before each position
        self.n_words = len(words)
        self.word = np.cumsum(self.blank) - 1 - self.blank  # a word's closing blank counts as its own
        self._ids: list[np.ndarray] = [np.zeros(len(self.codes), np.uint64)]

    def ids(self, order: int) -> np.ndarray:
        """At each position, the id of the gram of that many characters that ends there."""
        while len(self._ids) <= order:
            shifted = np.concatenate((np.zeros(1, np.uint64), self._ids[-1][:-1]))
            self._ids.append(shifted * _FACTOR + self.codes + np.uint64(1))
        return self._ids[order]

    def ends(self, order: int) -> np.ndarray:
        """Positions at which a gram of that order ends within one word."""
        at = np.arange(len(self.codes))
        inside = self.last_blank <= at - order + 1
        return np.nonzero(inside & (at >= max(order - 1, 1)) & ~(self.blank & (order == 1)))[0]


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """Where ids go in a table of ``2**bits`` places; ``slot_column`` is the same in SQL."""
    ids = ids.astype(np.uint64, copy=False)
    return ((ids ^ (ids >> np.uint64(32)) ^ (ids >> np.uint64(17))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def slot_column(column: str, bits: int) -> str:
    """SQL of a signed long id's slot."""
    return f"cast(({column} ^ shiftrightunsigned({column}, 32) ^ shiftrightunsigned({column}, 17)) & {(1 << bits) - 1} AS int)"
