"""Recompression of word sequences: globally consistent names for runs and pairs.

Names are hashes of what they stand for, so equal parts get equal names wherever
they are, on any executor, without a dictionary.  Every symbol carries the range
of words on which its presence depends; inside any sequence that holds this whole
range, the same symbol appears, so equal sequences share it.
"""

from __future__ import annotations

import numpy as np

from . import _words as W

FAR = np.int64(1) << 60
_U = np.uint64


def _name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return W.mix64(a * _U(0xD6E8FEB86659FD93) + W.mix64(b + _U(salt * 0x9E37 + 1)))


class Symbols:
    """Symbols of many texts in order: name, words [x, y), the words [cx, cy) that determine it, and the text."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray) -> None:
        self.name = words
        self.x = np.arange(len(words), dtype=np.int64)
        self.y = self.x + 1
        self.cx, self.cy = self.x.copy(), self.y.copy()
        self.text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))

    def _near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same text; what the left and right neighbours depend on."""
        n = len(self.name)
        same = np.zeros(n, dtype=bool)
        same[:-1] = self.text[:-1] == self.text[1:]
        left, right = np.full(n, -FAR), np.full(n, FAR)
        left[1:][same[:-1]] = self.cx[:-1][same[:-1]]
        right[:-1][same[:-1]] = self.cy[1:][same[:-1]]
        return same, left, right

    def runs(self) -> None:
        """Name maximal runs of one symbol."""
        if not len(self.name):
            return
        same, left, right = self._near()
        new = np.ones(len(self.name), dtype=bool)
        new[1:] = ~(same[:-1] & (self.name[1:] == self.name[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        size = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        self.name = np.where(size > 1, _name(name, size, 77), name)
        self.x, self.y, self.text = self.x[first], self.y[last], self.text[first]
        self.cx, self.cy = left[first], right[last]

    def pairs(self, salt: int) -> None:
        """Name pairs of a left and a right symbol; the name's hash decides the kind of each."""
        if not len(self.name):
            return
        same, left, right = self._near()
        is_left = (W.mix64(self.name + _U(salt * 0x51ED + 7)) & _U(1)).astype(bool)
        merge = np.zeros(len(self.name), dtype=bool)
        merge[:-1] = same[:-1] & is_left[:-1] & ~is_left[1:]
        second = np.zeros_like(merge)
        second[1:] = merge[:-1]
        cx = np.where(~is_left & ~second, left, self.cx)
        cy = np.where(is_left & ~merge, right, self.cy)
        at = np.flatnonzero(~second)
        to = at + merge[at]
        self.name = np.where(merge[at], _name(self.name[at], self.name[to], salt), self.name[at])
        self.x, self.y, self.text = self.x[at], self.y[to], self.text[at]
        self.cx, self.cy = cx[at], cy[to]


def recompress(words: np.ndarray, firsts: np.ndarray, rounds: int) -> Symbols:
    s = Symbols(words, firsts)
    s.runs()
    for k in range(rounds):
        s.pairs(k)
    return s
