"""Date dimension and month spine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from givetide.functions import months as m

MAX_YEARS = 400

MONTH_COLUMNS = [
    "month",
    "calendar_year",
    "month_name",
    "fiscal_year",
    "months_since",
    "is_current_month",
    "is_current_fiscal_year",
]


def calendar(spark: SparkSession, first: dt.date, last: dt.date, as_of: dt.date, fiscal_start: int = 4) -> DataFrame:
    """One row per day from ``first`` to ``last``, seen from ``as_of``.

    The span is checked: a calendar stays far below Spark's broadcast threshold.
    """
    days = (last - first).days + 1
    if not 0 < days <= MAX_YEARS * 366:
        raise ValueError(f"calendar span of {days} days is out of range")
    now = m.as_of_index(as_of)
    date = F.date_add(F.lit(first), F.col("id").cast("int"))
    return (
        spark.range(0, days, 1, 1)
        .select(date.alias("date"))
        .select(
            m.key_of_date(F.col("date")).alias("date_key"),
            "date",
            m.month_of_date(F.col("date")).alias("month"),
        )
        .select(
            "*",
            F.year("date").alias("calendar_year"),
            F.date_format("date", "MMMM").alias("month_name"),
            m.fiscal_year(F.col("month"), fiscal_start).alias("fiscal_year"),
            (F.lit(now) - m.index_of(F.col("month"))).cast("int").alias("months_since"),
            F.datediff(F.lit(as_of), F.col("date")).alias("days_since"),
        )
        .select(
            "*",
            (F.col("days_since") == 0).alias("is_current_date"),
            (F.col("months_since") == 0).alias("is_current_month"),
            (F.col("fiscal_year") == m.as_of_fiscal_year(as_of, fiscal_start)).alias("is_current_fiscal_year"),
        )
    )


def month_spine(dates: DataFrame) -> DataFrame:
    """One row per month of a date table, so that joins do not multiply by day."""
    return dates.groupBy(*MONTH_COLUMNS).agg(F.min("days_since").cast("int").alias("days_since_month_end"))
