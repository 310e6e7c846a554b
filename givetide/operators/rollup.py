"""Totals and distinct people of reporting groups rolled up along the hierarchy they form part of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.operators.metrics import TOTAL
from givetide.operators.spans import MONEY, merge_spans, span_totals
from givetide.operators.state import group_spans, totals_by_group
from givetide.sources.warehouse import settle


def ancestors(groups: DataFrame) -> DataFrame:
    """(group_id, ancestor_id, distance) for every listed group and each group above it, itself at distance 0.

    Pointers are doubled: ways of up to 2, 4, 8 … steps are joined end to end, so a tree of depth d takes log2(d)
    rounds, each settled. A parent that isn't listed is an ancestor that has none. A group that is listed with two
    parents, or that is its own ancestor, raises an error.
    """
    steps = groups.filter("group_id is not null").select("group_id", "forms_part_of").distinct()
    double = steps.groupBy("group_id").count().filter("count > 1").orderBy("group_id").first()
    if double:
        raise ValueError(f"group {double['group_id']} is listed with more than one parent")
    ways = settle(steps.filter("forms_part_of is not null").select("group_id", F.col("forms_part_of").alias("ancestor_id"), F.lit(1).alias("distance")))
    reach = 1
    while True:
        circle = ways.filter("group_id = ancestor_id").orderBy("group_id").first()
        if circle:
            raise ValueError(f"group {circle['group_id']} forms part of itself")
        longest = ways.filter(F.col("distance") == reach).select("group_id", F.col("ancestor_id").alias("_at"))
        if longest.isEmpty():
            break
        onward = ways.select(F.col("group_id").alias("_at"), "ancestor_id", (F.col("distance") + reach).alias("distance"))
        ways = settle(ways.unionByName(longest.join(onward, "_at").drop("_at")))
        reach *= 2
    return ways.unionByName(steps.select("group_id", F.col("group_id").alias("ancestor_id"), F.lit(0).alias("distance")))


def metrics_by_level(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Metrics per type, month and group of every level: each group's own total and those of all groups below it.

    ``own_total`` is what was assigned to the group itself, NULL where nothing was. Totals of groups that aren't listed,
    and of no group, stay by themselves, without a level.
    """
    keyed = metrics.groupBy("type", "month", "group_id").agg(F.sum("total").cast(TOTAL).alias("total"))
    up = ancestors(groups).select(F.col("group_id").alias("_group"), "ancestor_id", "distance")
    names = groups.select(F.col("group_id").alias("_id"), "forms_part_of", "level", "description").distinct()
    raised = keyed.join(up, F.col("group_id") == F.col("_group"), "left").select(
        "type", "month", F.coalesce("ancestor_id", "group_id").alias("group_id"), F.coalesce("distance", F.lit(0)).alias("distance"), "total"
    )
    return (
        raised.groupBy("type", "month", "group_id")
        .agg(F.sum("total").cast(TOTAL).alias("total"), F.sum(F.when(F.col("distance") == 0, F.col("total"))).cast(TOTAL).alias("own_total"))
        .join(names, F.col("group_id") == F.col("_id"), "left")
        .select("type", "month", "group_id", "forms_part_of", "level", "description", "own_total", "total")
    )


def active_gifts_by_level(w, details: DataFrame, groups: DataFrame, as_of: dt.date) -> DataFrame:
    """Distinct givers and gifts, and cumulative value, per month and group of every level.

    Someone who gives in several groups counts once in each group above them; ``givers_summed`` is the sum of the distinct
    givers of the assigned groups, which counts them once in each. The months in which someone gives in a group are merged
    before they are raised, and again for each group above, so no row per person and month arises; values and summed
    givers are raised as monthly totals. Groups that aren't listed, and no group, stay by themselves, without a level.
    """
    spans = settle(group_spans(w, details, as_of))
    up = settle(ancestors(groups).select(F.col("group_id").alias("_group"), "ancestor_id"))

    def raised(df: DataFrame) -> DataFrame:
        found = df.join(up, F.col("group_id") == F.col("_group"), "left")
        return found.withColumn("group_id", F.coalesce("ancestor_id", "group_id")).drop("_group", "ancestor_id")

    def present(key: str, givers: int, gifts: int) -> DataFrame:
        keys = [key, "group_id"]
        merged = merge_spans(raised(merge_spans(spans.select(*keys, "start", "stop"), keys)), keys)
        return merged.select("group_id", "start", "stop", F.lit(givers).alias("p"), F.lit(gifts).alias("g"))

    distinct = span_totals(present("constituent_id", 1, 0).unionByName(present("gift_id", 0, 1)), ["group_id"], {}, {"givers": "p", "gifts": "g"})
    summed = raised(totals_by_group(spans)).select("month", "group_id", F.col("givers").alias("givers_summed"), "value")
    names = groups.select(F.col("group_id").alias("_id"), "forms_part_of", "level", "description").distinct()
    return (
        distinct.unionByName(summed, allowMissingColumns=True)
        .groupBy("month", "group_id")
        .agg(*[F.sum(c).alias(c) for c in ("givers", "givers_summed", "gifts")], F.sum("value").cast(MONEY).alias("value"))
        .join(names, F.col("group_id") == F.col("_id"), "left")
        .select("month", "group_id", "forms_part_of", "level", "description", "givers", "givers_summed", "gifts", "value")
    )
