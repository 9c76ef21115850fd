"""Pairs of alike lines, in order, with the greatest sum of likeness.

The helper behind ``operators.pairing``: it sees the words of the lines of one
run of changes.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle

#: Cells of the table kept at once; larger tables are halved first.
CELLS = 1 << 24

Words = list[list[str]]


class _Side:
    """The words of the added lines by word, so that a removed line meets only lines that share one."""

    def __init__(self, lines: Words):
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        found: dict[str, tuple[list[int], list[int]]] = {}
        for j, line in enumerate(lines):
            for word, n in Counter(line).items():
                places, counts = found.setdefault(word, ([], []))
                places.append(j)
                counts.append(n)
        self.by_word = {w: (np.array(p), np.array(n)) for w, (p, n) in found.items()}

    def likeness(self, line: list[str], least: int) -> np.ndarray:
        """Words shared, twice over all words, in thousandths; 0 below ``least``."""
        shared = np.zeros(len(self.sizes), np.int64)
        for word, n in Counter(line).items():
            if word in self.by_word:
                places, counts = self.by_word[word]
                shared[places] += np.minimum(counts, n)
        out = 2000 * shared // np.maximum(self.sizes + len(line), 1)
        return np.where(out >= least, out, 0)


def _next(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
    best = row.copy()
    best[1:] = np.maximum(row[1:], row[:-1] + gain)
    return np.maximum.accumulate(best)


def _totals(olds: Words, news: Words, least: int) -> np.ndarray:
    """Greatest sum of all ``olds`` with every beginning of ``news``."""
    side, row = _Side(news), np.zeros(len(news) + 1, np.int64)
    for line in olds:
        row = _next(row, side.likeness(line, least))
    return row


def best_pairs(olds: Words, news: Words, least: int) -> list[tuple[int, int, int]]:
    """``(i, j, likeness)`` ascending in both, with the greatest sum there is.

    Only lines at least ``least`` thousandths alike pair.  A table over CELLS is cut at half
    of ``olds`` where both halves' sums add up to the most, so memory stays bounded.
    """
    found, todo = [], [(0, len(olds), 0, len(news))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n * m > CELLS and n > 1:
            mid = (a0 + a1) // 2
            total = _totals(olds[a0:mid], news[b0:b1], least) + _totals(olds[mid:a1][::-1], news[b0:b1][::-1], least)[::-1]
            cut = b0 + int(total.argmax())
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        side, table = _Side(news[b0:b1]), np.zeros((n + 1, m + 1), np.int64)
        for i in range(n):
            table[i + 1] = _next(table[i], side.likeness(olds[a0 + i], least))
        i, j = n, m
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((a0 + i, b0 + j, int(table[i + 1, j + 1] - table[i, j])))
    return sorted(found)


# Workers get this module's functions by value, so they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
