"""Actuals against targets, year to date, and long-term trends.

The inputs here are already summed per type, group and month: thousands of rows, however
large the facts were.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.functions import text

METRIC = ["type", "month", "group_id", "forms_part_of", "level", "description", "total"]
TOTAL = "decimal(38,4)"
SETTLED_DAYS = 15


FAITH_GOAL = "Count of distinct faith groups making donation in month"


def percent_over(actual: Column, target: Column) -> Column:
    """Percentage over target; NULL where either side is NULL or zero."""
    gap = (actual - target).cast("double")
    return F.when((target != 0) & (actual != 0), 100 * gap / target.cast("double"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the comparison key of their type: the target table is kept by hand and spells types its own way."""
    return rows.withColumn("_type", text.fold(F.col("type")))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def compare_to_targets(metrics: DataFrame, targets: DataFrame, months: DataFrame, as_of: dt.date) -> DataFrame:
    """Monthly actuals with target, over/under and percentage, from the first target month.

    A target without an actual keeps NULL keys, as only the actual's columns are kept.
    """
    now = m.as_of_month(as_of)
    fiscal = months.filter("is_current_fiscal_year").select(F.col("month").alias("_fiscal_month"))
    earliest = targets.agg(F.min("month")).scalar()
    t = targets.select(
        F.col("type").alias("_t_type"), F.col("month").alias("_t_month"), F.col("group_id").alias("_t_group"), F.col("target").alias("_target")
    )
    same_key = (
        (F.col("month") == F.col("_t_month")) & (F.col("group_id") == F.col("_t_group")) & (text.fold(F.col("type")) == text.fold(F.col("_t_type")))
    )
    target = F.col("_target")
    return (
        metrics.select(*METRIC)
        .join(t, same_key, "full")
        .filter((F.col("month") >= earliest) | (F.col("_t_month") >= earliest))
        .join(fiscal, F.col("month") == F.col("_fiscal_month"), "left")
        .select(
            *METRIC,
            _flag(F.col("month") == now).alias("is_current_month"),
            _flag(F.col("month") > now).alias("is_future_month"),
            _flag(F.col("_fiscal_month").isNotNull()).alias("is_in_current_fy"),
            F.coalesce(target, F.lit(0)).cast(TOTAL).alias("target"),
            (F.col("total") - F.coalesce(target, F.lit(0))).cast(TOTAL).alias("over_under"),
            percent_over(F.col("total"), target).alias("pct_over_under"),
        )
        .distinct()
    )


def future_targets(working: DataFrame, targets: DataFrame, months: DataFrame) -> DataFrame:
    """Targets of future months that have no row yet, to be appended to ``working``."""
    ahead = months.filter("months_since < 0").select("month")
    return (
        _keyed(targets.filter("type is not null and group_id is not null"))
        .join(ahead, "month", "left_semi")
        .join(_keyed(working).select("_type", "month", "group_id"), ["_type", "month", "group_id"], "left_anti")
        .select(
            "type",
            "month",
            "group_id",
            "forms_part_of",
            "level",
            "description",
            F.lit(0).cast(TOTAL).alias("total"),
            F.lit(0).alias("is_current_month"),
            F.lit(1).alias("is_future_month"),
            F.lit(1).alias("is_in_current_fy"),
            F.coalesce("target", F.lit(0)).cast(TOTAL).alias("target"),
            F.lit(None).cast(TOTAL).alias("over_under"),
            F.lit(None).cast("double").alias("pct_over_under"),
        )
    )


def _unmet(working: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets without an actual, in months that occur among the actuals."""
    seen = working.select("month").distinct()
    met = _keyed(working).select("_type", "month", "group_id")
    return _keyed(targets).join(met, ["_type", "month", "group_id"], "left_anti").join(seen, "month", "left_semi")


def zero_income_ytd_targets(working: DataFrame, targets: DataFrame, months: DataFrame) -> DataFrame:
    """Targets so far this fiscal year of types and groups that have no actual."""
    so_far = months.filter("months_since > -1 and is_current_fiscal_year").select("month")
    return (
        _unmet(working, targets)
        .join(so_far, "month", "left_semi")
        .groupBy("_type", "group_id")
        .agg(F.min("type").alias("type"), F.sum("target").cast(TOTAL).alias("ytd_target"))
        .select("type", "group_id", "ytd_target")
    )


def ytd_results(working: DataFrame, targets: DataFrame, months: DataFrame, as_of: dt.date) -> DataFrame:
    """Monthly rows with the year to date of their type and group, plus unmet targets.

    The current month does not count towards the year to date, and types and groups
    without a row in the current fiscal year are left out.
    """
    now = m.as_of_month(as_of)
    fiscal = months.filter("is_current_fiscal_year").select("month")
    zero = F.lit(0).cast(TOTAL)
    so_far = F.col("month") < now
    ytd = (
        _keyed(working)
        .join(fiscal, "month", "left_semi")
        .groupBy("_type", "group_id")
        .agg(
            F.sum(F.when(so_far, F.col("total")).otherwise(zero)).cast(TOTAL).alias("ytd_actual"),
            F.sum(F.when(so_far, F.col("target")).otherwise(zero)).cast(TOTAL).alias("ytd_target"),
        )
        .withColumn("ytd_over_under", (F.col("ytd_actual") - F.coalesce("ytd_target", zero)).cast(TOTAL))
        .withColumn("ytd_pct_over_under", percent_over(F.col("ytd_actual"), F.col("ytd_target")))
    )
    columns = [
        "type", "group_id", "ytd_actual", "ytd_target", "ytd_over_under", "ytd_pct_over_under", "month", "forms_part_of",
        "level", "description", "is_current_month", "is_future_month", "month_actual", "target", "over_under", "pct_over_under",
    ]
    met = ytd.join(_keyed(working), ["_type", "group_id"]).withColumnRenamed("total", "month_actual").select(*columns)
    missed = (
        _unmet(working, targets)
        .join(_keyed(zero_income_ytd_targets(working, targets, months)).drop("type"), ["_type", "group_id"], "left")
        .select(
            "type",
            "group_id",
            F.lit(None).cast(TOTAL).alias("ytd_actual"),
            "ytd_target",
            F.lit(None).cast(TOTAL).alias("ytd_over_under"),
            F.lit(None).cast("double").alias("ytd_pct_over_under"),
            "month",
            "forms_part_of",
            "level",
            "description",
            _flag(F.col("month") == now).alias("is_current_month"),
            F.lit(0).alias("is_future_month"),
            zero.alias("month_actual"),
            F.col("target").cast(TOTAL).alias("target"),
            (0 - F.col("target")).cast(TOTAL).alias("over_under"),
            F.lit(None).cast("double").alias("pct_over_under"),
        )
    )
    return met.unionByName(missed).distinct()


def long_term_trends(metrics: DataFrame, months: DataFrame, stored_at: dt.datetime) -> DataFrame:
    """Metrics with fiscal year and sequence, for months that ended long enough ago.

    The sequence is numbered before the recent months are dropped.
    """
    spine = months.select("month", "fiscal_year", "days_since_month_end")
    order = Window.partitionBy("type", "group_id").orderBy("month", "forms_part_of", "level", "description", "total")
    return (
        metrics.select(*METRIC)
        .join(spine, "month")
        .withColumn("sequence", F.row_number().over(order))
        .filter((F.col("days_since_month_end") > SETTLED_DAYS) & text.differs(F.col("type"), "ActualReceivedRGIncome"))
        .select(
            F.lit(stored_at).alias("date_stored"),
            *METRIC,
            "fiscal_year",
            (F.col("month") % 100).cast("int").alias("month_number"),
            "days_since_month_end",
            "sequence",
        )
    )


PACK_CATEGORIES = {
    # Item -> category of the pack request targets.
    "Pupil Pipeline Pack": "Pupil Pipeline pack request",
    "Primary School Pack": "Water Resource pack request",
    "Secondary School Pack": "Water Resource pack request",
}

TARGET_KEYS = ["target_category", "target_description", "subcategory", "fiscal_year", "month", "target_value"]


def _targets_with_year(w, targets: DataFrame) -> DataFrame:
    years = w.months.select("month", "fiscal_year").distinct()
    return targets.join(years, "month")


def pack_requests_vs_target(w) -> DataFrame:
    """Pack requests sent by letter, counted and summed per target month; zero when none."""
    item = F.col("item")
    category = None
    for name, label in PACK_CATEGORIES.items():
        category = (F if category is None else category).when(text.same(item, name), label)
    letters = w.material_sent.filter(text.contains(item, "Pack") & (F.col("letter_activity_id") > -1)).select(
        "material_id", "quantity", F.col("letter_activity_id").alias("activity_id"), category.alias("_category")
    )
    # Summed per category and month before meeting the targets.
    sent = (
        letters.filter("_category is not null")
        .join(w.activity.select("activity_id", "end_date_key"), "activity_id")
        .groupBy("_category", m.month_of_key(F.col("end_date_key")).alias("month"))
        .agg(F.count("material_id").alias("_count"), F.sum("quantity").alias("_quantity"))
        .select(text.fold(F.col("_category")).alias("_category"), F.col("month").alias("_month"), "_count", "_quantity")
    )
    wanted = w.nonfinancial_target.filter(
        text.same(F.col("team"), "Community and Events")
        & text.same(F.col("target_description"), "Count of pack requests made in month")
        & text.contains(F.col("subcategory"), "pack request")
    )
    return (
        _targets_with_year(w, wanted)
        .join(sent, (text.fold(F.col("subcategory")) == F.col("_category")) & (F.col("month") == F.col("_month")), "left")
        .groupBy(*TARGET_KEYS)
        .agg(F.coalesce(F.sum("_count"), F.lit(0)).alias("actual_value"), F.coalesce(F.sum("_quantity"), F.lit(0)).alias("extra_stat_value"))
        .withColumn("extra_stat_description", F.lit("Sum_IndividualPacksRequested"))
    )


def _faith_groups(w) -> DataFrame:
    return w.constituent.filter(
        text.same(F.col("key_indicator"), "O") & text.same(F.col("organisation_type"), "Faith Groups")
    )


def faith_groups_vs_target(w) -> DataFrame:
    """Distinct faith groups giving per month, and their total; NULL when none gave."""
    actuals = (
        w.payment.join(_faith_groups(w).select("constituent_key"), "constituent_key")
        .groupBy(m.month_of_key(F.col("donation_date_key")).alias("month"))
        .agg(F.count_distinct("constituent_key").alias("faith_groups"), F.sum("amount").alias("amount_given"))
    )
    wanted = w.nonfinancial_target.filter(text.same(F.col("target_description"), FAITH_GOAL))
    return _targets_with_year(w, wanted).join(actuals, "month", "left").select(*TARGET_KEYS, "faith_groups", "amount_given")


def faith_group_payments(w) -> DataFrame:
    """Single payments of faith groups in the months that have a target."""
    goal_months = w.nonfinancial_target.filter(text.same(F.col("target_description"), FAITH_GOAL)).select("month").distinct()
    return (
        w.payment.join(_faith_groups(w), "constituent_key")
        .withColumn("month", m.month_of_key(F.col("donation_date_key")))
        .join(goal_months, "month", "left_semi")
        .select(
            "constituent_key", "organisation_category", "organisation_diocese", "organisation_name", "donation_date_key", "month", "payment_id", "amount"
        )
    )


def fiscal_year_totals(metrics: DataFrame, months: DataFrame) -> DataFrame:
    """Metrics per fiscal year."""
    return (
        metrics.join(months.select("month", "fiscal_year"), "month")
        .groupBy("type", "fiscal_year", "group_id", "forms_part_of", "level", "description")
        .agg(F.sum("total").cast(TOTAL).alias("total"))
    )
