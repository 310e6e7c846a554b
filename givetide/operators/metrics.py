"""The seven monthly metrics, in one long table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions.rules import named_values
from givetide.operators.actions import event_signups, event_signups_filled, pack_sends, pack_sends_filled
from givetide.operators.groups import CASH_RULES, REGULAR_RULES, classify_cash, classify_regular, classify_rg_income
from givetide.operators.history import amendment_facts, cancellation_facts, new_gift_facts
from givetide.operators.income import cash_gift_facts

KEYS = ["type", "month", "group_id", "forms_part_of", "level", "description"]
TOTAL = "decimal(38,4)"

RULE_COLUMNS = ["month", "descriptor", "product", "audience", "appeal_type", "package_category"]


def regular_metric(w, facts: DataFrame, metric: str, variant: str) -> DataFrame:
    """Sum a regular-gift movement per month and group.

    Facts are summed by what the rules look at before the rules run, so the long CASE is
    evaluated on a few thousand combinations and not on every fact. Counted facts add up as often as they stand.
    """
    value = F.col("value") * F.col("copies") if "copies" in facts.columns else F.col("value")
    summed = facts.groupBy(*RULE_COLUMNS).agg(F.sum(value).alias("total"))
    return _per_group(w, classify_regular(variant, summed, w.known_descriptor), metric)


def cash_metric(w, facts: DataFrame) -> DataFrame:
    """Sum cash per month and group; a group missing from the hierarchy loses its id."""
    keys = ["month", "descriptor", "product", "audience", "gift_code", "rolling_sms"]
    summed = named_values(facts, CASH_RULES).groupBy(*keys).agg(F.sum("amount").alias("total"))
    return _per_group(w, classify_cash(summed, w.known_descriptor), "ValueOfCashGifts", listed_only=True)


def rg_income_metric(w) -> DataFrame:
    return _per_group(w, classify_rg_income(w.rg_income).withColumnRenamed("value", "total"), "ActualReceivedRGIncome")


def _per_group(w, df: DataFrame, metric: str, listed_only: bool = False) -> DataFrame:
    groups = w.group.select(F.col("group_id").alias("_listed"), "forms_part_of", "level", "description")
    keyed = df.groupBy("month", "group_id").agg(F.sum("total").cast(TOTAL).alias("total"))
    joined = keyed.join(groups, F.col("group_id") == F.col("_listed"), "left")
    if listed_only:
        joined = joined.withColumn("group_id", F.col("_listed"))
    return (
        joined.withColumn("type", F.lit(metric)).groupBy(*KEYS).agg(F.sum("total").cast(TOTAL).alias("total"))
    )


def action_metric(filled: DataFrame, column: str) -> DataFrame:
    return filled.groupBy(*KEYS).agg(F.sum(column).cast(TOTAL).alias("total"))


def monthly_metrics(w, changes: DataFrame, as_of: dt.date) -> DataFrame:
    """Seven tagged branches summed by type, month and group.

    ``changes`` is a settled rule history, as three branches read it; a counted one holds fewer rows and gives the same.
    """
    # Values that no rule names are one from here on, so that shuffled rows are narrow and sums have few.
    seen = {variant: named_values(changes, REGULAR_RULES[variant]) for variant in ("NEW", "CHANGE", "CANCEL")}
    branches = [
        regular_metric(w, new_gift_facts(w, seen["NEW"]), "AnnualValueOfNewRegularGifts", "NEW"),
        regular_metric(w, amendment_facts(w, seen["CHANGE"]), "AnnualValueOfChangesToRegularGifts", "CHANGE"),
        regular_metric(w, cancellation_facts(w, seen["CANCEL"]), "AnnualValueCancelledThisMonth", "CANCEL"),
        cash_metric(w, cash_gift_facts(w)),
        rg_income_metric(w),
        action_metric(event_signups_filled(w, event_signups(w), as_of), "signups"),
        action_metric(pack_sends_filled(w, pack_sends(w), as_of), "sends"),
    ]
    return reduce(DataFrame.unionByName, branches)
