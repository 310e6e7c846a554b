"""Rows of zero for what did not happen, so that year-to-date sums add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions import months as m


def zero_fill_since_first(df: DataFrame, keys: Sequence[str], current_index: int) -> DataFrame:
    """Keys and months without a row, from the key's first month to the current month.

    One shuffle: the months a key has are a set no larger than the calendar.
    """
    index = m.index_of(F.col("month"))
    seen = df.filter(F.col("month").isNotNull()).groupBy(*keys).agg(F.min(index).alias("_first"), F.collect_set(index).alias("_seen"))
    wanted = F.sequence(F.col("_first"), F.lit(current_index))
    return (
        seen.filter(F.col("_first") <= current_index)
        .select(*keys, F.explode(F.array_except(wanted, F.col("_seen"))).alias("_i"))
        .select(*keys, m.month_at(F.col("_i")).alias("month"))
    )


def fill_missing_fiscal_months(metrics: DataFrame, months: DataFrame, groups: DataFrame) -> DataFrame:
    """Zero rows for every past month of each fiscal year in which (type, group) has a row.

    Months before the first activity of that year are filled as well. The result is the
    added rows only.
    """
    years = months.select("month", "fiscal_year")
    past = months.filter("months_since > -1").select("month", "fiscal_year")
    keys = metrics.join(years, "month").select("fiscal_year", "type", "group_id").distinct()
    have = metrics.select(
        F.col("month").alias("_month"), F.col("type").alias("_type"), F.col("group_id").alias("_group")
    )
    missing = (
        keys.join(past, "fiscal_year")
        .join(
            have,
            (F.col("month") == F.col("_month"))
            & F.col("type").eqNullSafe(F.col("_type"))
            & F.col("group_id").eqNullSafe(F.col("_group")),
            "left_anti",
        )
    )
    names = groups.select("group_id", "forms_part_of", "level", "description")
    return missing.join(names, "group_id", "left").select(
        "type",
        "month",
        "group_id",
        "forms_part_of",
        "level",
        "description",
        F.lit(0).cast("decimal(38,4)").alias("total"),
    )
