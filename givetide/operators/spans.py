"""Month spans: the skew-safe replacement for month-range joins.

Joining every gift to every month from its start on multiplies the facts by the number
of months before anything is reduced. Here a fact stays one row with a half-open span of
month indexes ``[start, stop)``; totals per month come from summing +value at the start
and -value at the stop, and a running total over the (few) distinct months of each key.

Every window below runs over rows already grouped by (key, month), so one window group
never holds more rows than the calendar has months, however hot its key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from givetide.functions import months as m

MONEY = "decimal(19,4)"


def expand_months(df: DataFrame, start: str = "start", stop: str = "stop", month: str = "month") -> DataFrame:
    """One row per month of each span; empty spans give none."""
    rest = [c for c in df.columns if c not in (start, stop)]
    return (
        df.filter(F.col(start) < F.col(stop))
        .select(*rest, F.explode(F.sequence(F.col(start), F.col(stop) - 1)).alias("_i"))
        .select(*rest, m.month_at(F.col("_i")).alias(month))
    )


def merge_spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the overlapping or touching spans of each key."""
    ordered = Window.partitionBy(*keys).orderBy("start")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.filter(F.col("start") < F.col("stop"))
        .groupBy(*keys, "start")
        .agg(F.max("stop").alias("stop"))
        .withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_island")
    )


def span_steps(df: DataFrame, keys: Sequence[str], sums: dict[str, Column | str], counts: dict[str, Column | str]) -> DataFrame:
    """Rows ``(keys, start, stop, totals)`` with constant totals and at least one live span.

    ``sums`` adds up money (NULL when no live row has a value); ``counts`` adds up the
    given 0/1 columns. Keys are null-equal, as in a GROUP BY.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    flat = df.filter(F.col("start") < F.col("stop")).select(
        *keys,
        "start",
        "stop",
        *[as_col(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[as_col(c).cast("long").alias(f"_c_{n}") for n, c in counts.items()],
    )
    marks = flat.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")),
                F.struct(F.col("stop").alias("at"), F.lit(-1).alias("sign")),
            )
        ).alias("_m"),
    )
    sign = F.col("_m.sign")
    deltas = marks.groupBy(*keys, F.col("_m.at").alias("start")).agg(
        F.sum(sign.cast("long")).alias("_live"),
        *[F.sum(F.when(sign > 0, F.col(f"_s_{n}")).otherwise(-F.col(f"_s_{n}"))).alias(f"_s_{n}") for n in sums],
        *[F.sum(F.when(F.col(f"_s_{n}").isNotNull(), sign.cast("long"))).alias(f"_n_{n}") for n in sums],
        *[F.sum(F.when(sign > 0, F.col(f"_c_{n}")).otherwise(-F.col(f"_c_{n}"))).alias(f"_c_{n}") for n in counts],
    )
    ordered = Window.partitionBy(*keys).orderBy("start")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.sum(c).over(upto)
    steps = deltas.select(
        *keys,
        "start",
        F.lead("start").over(ordered).alias("stop"),
        running("_live").alias("_live"),
        *[F.when(running(f"_n_{n}") > 0, running(f"_s_{n}")).alias(n) for n in sums],
        *[running(f"_c_{n}").alias(n) for n in counts],
    )
    return steps.filter("_live > 0").drop("_live")


def span_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, Column | str], counts: dict[str, Column | str] | None = None) -> DataFrame:
    """Totals per key and month over the spans live in that month."""
    steps = span_steps(df, keys, sums, counts or {})
    return expand_months(steps).select(*keys, "month", *sums, *(counts or {}))
