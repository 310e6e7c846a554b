"""Month arithmetic on int yyyymm keys.

A *month index* is ``year * 12 + month - 1``; consecutive months differ by one, which
turns every "months since" comparison into integer arithmetic on codegen'd columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of_key(date_key: Column) -> Column:
    """yyyymmdd int -> yyyymm int."""
    return F.floor(date_key / 100).cast("int")


def month_of_date(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def key_of_date(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def index_of(month: Column) -> Column:
    """yyyymm int -> month index."""
    return (F.floor(month / 100) * 12 + month % 100 - 1).cast("int")


def month_at(index: Column) -> Column:
    """Month index -> yyyymm int."""
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")


def fiscal_year(month: Column, first_month: int = 4) -> Column:
    """Fiscal year of a yyyymm key, named by the year in which it ends."""
    year = F.floor(month / 100)
    if first_month == 1:
        return year.cast("int")
    return (year + F.when(month % 100 >= first_month, 1).otherwise(0)).cast("int")


def as_of_index(as_of: dt.date) -> int:
    return as_of.year * 12 + as_of.month - 1


def as_of_month(as_of: dt.date) -> int:
    return as_of.year * 100 + as_of.month


def as_of_fiscal_year(as_of: dt.date, first_month: int = 4) -> int:
    return as_of.year + (1 if first_month > 1 and as_of.month >= first_month else 0)
