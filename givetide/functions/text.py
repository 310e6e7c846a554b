"""Case-blind text tests that keep SQL's three-valued logic.

The warehouse compares text without regard to case, so ``'SDev x'`` matches a
``'Sdev'`` prefix. Equality, also of join and grouping keys, ignores trailing blanks; tests of
parts of a text don't. Each test lowers the column once per expression; Spark's common
subexpression elimination shares it between the arms of one rule list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(col: Column) -> Column:
    """The comparison key of a text column; use it on both sides of a join."""
    return F.rtrim(F.lower(col))


def same(col: Column, value: str) -> Column:
    return fold(col) == value.lower().rstrip(" ")


def differs(col: Column, value: str) -> Column:
    return fold(col) != value.lower().rstrip(" ")


def one_of(col: Column, values) -> Column:
    return fold(col).isin([v.lower().rstrip(" ") for v in values])


def starts(col: Column, *prefixes: str) -> Column:
    return reduce(Column.__or__, (F.lower(col).startswith(p.lower()) for p in prefixes))


def contains(col: Column, *parts: str) -> Column:
    return reduce(Column.__or__, (F.lower(col).contains(p.lower()) for p in parts))
