"""Similarity scores from 0 to 100, from their published definitions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit vector at a time."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * lcs(a, b)


def _share(distance: int, total: int) -> float:
    return 100.0 if total == 0 else 100.0 * (1 - distance / total)


def ratio(a: str, b: str) -> float:
    return _share(_indel(a, b), len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(65536)
def token_set_ratio(a: str, b: str) -> float:
    x, y = {*a.split()}, {*b.split()}
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    head = len(" ".join(both))
    space = 1 if both else 0
    n, m = head + space + len(left), head + space + len(right)
    best = _share(_indel(left, right), n + m)
    if both:
        best = max(best, _share(n - head, head + n), _share(m - head, head + m))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text to any window of the longer, cut at its ends as well."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = 0.0
    for start in range(1 - len(a), len(b)):
        best = max(best, ratio(a, b[max(0, start) : start + len(a)]))
        if best == 100.0:
            break
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = {*a.split()}, {*b.split()}
    if x & y:
        return 100.0
    left, right = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return max(partial_ratio(left, right), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


@lru_cache(65536)
def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def best_of(xs, ys, score) -> float:
    return max((score(x, y) for x in xs for y in ys), default=0.0)


@F.pandas_udf(T.DoubleType())
def best_set_ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Best token-set ratio over two lists of forms."""
    return pd.Series([best_of(x if x is not None else (), y if y is not None else (), token_set_ratio) for x, y in zip(xs, ys)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(query: pd.Series, names: pd.Series) -> pd.Series:
    """Best ratio of the query to any name, 0 to 1; 0 for an empty query."""
    return pd.Series([best_of([q], [n for n in ns if n], ratio) / 100 if q else 0.0 for q, ns in zip(query, names)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
