"""Helpers for large expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairs(table: list[tuple] | dict) -> Column:
    """A literal array of structs k, v in order."""
    items = table.items() if isinstance(table, dict) else table
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in items])


def first_where(table: list[tuple] | dict, holds: Callable[[Column], Column]) -> Column:
    """Value of the first entry whose key satisfies the test, else null."""
    return F.get(F.filter(pairs(table), lambda x: holds(x["k"])), F.lit(0))["v"]


def any_word(words) -> str:
    """A pattern of alternatives."""
    return "|".join(re.escape(w) for w in words)
