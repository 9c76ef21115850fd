"""Longest common subsequence of two lists of line numbers, and the edit blocks around it.

The helper behind ``operators.linediff``: it sees 64-bit numbers of lines, never
their text, and only the part of a version between its first and last change.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

#: Bits of rows kept at once; larger tables are halved first.
CELLS = 1 << 26


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of ``a`` the table's row as an integer: bit j is 0 where b[:j + 1] has one match more than b[:j]."""
    full = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    row = full
    for x in a:
        at = row & places.get(x, 0)
        row = ((row + at) | (row - at)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8)
    zeros = 1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending.

    Exact for any input.  A row of the table is one integer, so an item costs
    len(b) / 64 machine words; a table over CELLS bits is cut at half of ``a``
    where both halves' lengths add up to the most, so memory stays bounded.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n * m > CELLS and n > 1:
            mid = (a0 + a1) // 2
            total = _lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(total.argmax())
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        rows = list(_rows(a[a0:a1], b[b0:b1]))
        i, j = n, m
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((a0 + i, b0 + j))
    return sorted(found)


def blocks(a: list[int], b: list[int]) -> list[dict[str, int]]:
    """The stretches that differ: place and length in ``a``, place and length in ``b``."""
    out, i, j = [], 0, 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append({"a": i, "la": p - i, "b": j, "lb": q - j})
        i, j = p + 1, q + 1
    return out


# Workers get this module's functions by value, so they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
