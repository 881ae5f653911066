"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed on Arrow buffers."""

from __future__ import annotations

import numpy as np

from placewright.llm.perfect_hash import mix

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 31)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 modulo 2 ** 64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1] * _BASE)])
    return _powers[:n]


_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverse = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverse
    while len(_inverse) < n:
        _inverse = np.concatenate([_inverse, _inverse * (_inverse[-1] * _BACK)])
    return _inverse[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word (run of other than ASCII white space, A-Z lower-cased)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, edge = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * powers(len(data)))])
        h = (total[last] - total[first]) * inverses(len(data))[first]
        h = mix(h + (last - first).astype(np.uint64), 1)
    return h, np.searchsorted(offsets, first, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``width`` words make one shingle, none make none."""
    h, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        joined = mix(h, 2)
        for k in range(1, width):
            joined[:-k or None] = mix(joined[:-k or None] * _BASE + h[k:], 2) if len(h) > k else joined[:0]
        joined = joined[: len(h)]
    out = []
    for d in range(n):
        a, b = start[d], start[d + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = mix(np.array([x * _BASE + w]), 3)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
