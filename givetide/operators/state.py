"""The state of each regular gift at each month end.

Precondition of the change fact: (gift, sequence) identifies one change.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.functions import text
from givetide.operators.spans import expand_months, merge_spans, span_totals
from givetide.sources.warehouse import settle

PERSON_GIFT = ["constituent_id", "gift_id"]

# Fixed value: month given to undated cancellations in the by-group totals.
LONG_AGO = 197912


def _dated(w, history: DataFrame) -> DataFrame:
    days = w.calendar.select(F.col("date_key").alias("change_date_key"), F.col("month"))
    return history.join(days, "change_date_key")


def _with_payment_type(w, df: DataFrame) -> DataFrame:
    """``df`` carries the gift's payment type key; unknown keys drop out."""
    names = w.payment_type.select("payment_type_id", "payment_type")
    return df.join(names, "payment_type_id").drop("payment_type_id")


def latest_state_per_month(w, history: DataFrame) -> DataFrame:
    """Amount at the highest sequence of each (person, gift, month), with payment type.

    ``rank() <= 1`` lets Spark drop all but the top rows of each group before the
    shuffle, so a gift with very many amendments sends little. Rows that share the top
    sequence are all kept.
    """
    top = Window.partitionBy(*PERSON_GIFT, "month").orderBy(F.col("sequence").desc())
    latest = (
        _dated(w, history)
        .select(*PERSON_GIFT, "month", "sequence", "annual_amount", "payment_type_id")
        .withColumn("_rank", F.rank().over(top))
        .filter("_rank <= 1")
        .drop("_rank")
    )
    return _with_payment_type(w, latest).select(*PERSON_GIFT, "month", "sequence", "payment_type", "annual_amount")


def unrealistic_gifts(w, gifts: DataFrame | None = None) -> DataFrame:
    """Large online regular gifts that were never paid; they are left out everywhere.

    Pass only the regular ``gifts`` when the result serves to leave gifts out of the
    history, which has no others.
    """
    gifts = w.gift if gifts is None else gifts
    online = w.gift_code.filter(text.same(F.col("gift_code_description"), "Website Direct Debit")).select("gift_code_id")
    suspects = w.rg_fact.filter(
        F.col("first_instalment_date").isNull()
        & ~text.one_of(F.col("gift_status"), ["Held", "Active"])
        & text.same(F.col("has_been_upgraded"), "No")
        & (F.col("annual_amount") > 1800)
    )
    return gifts.join(online, "gift_code_id").select("gift_id").join(suspects.select("gift_id"), "gift_id")


def without_gifts(df: DataFrame, unwanted: DataFrame) -> DataFrame:
    return df.join(unwanted.select("gift_id"), "gift_id", "left_anti")


def every_month_since_start(w, history: DataFrame, as_of: dt.date) -> DataFrame:
    """Gift x month from its first month to the last complete month."""
    first = _dated(w, history).groupBy("gift_id").agg(F.min("month").alias("month"))
    spans = first.select("gift_id", m.index_of(F.col("month")).alias("start"), F.lit(m.as_of_index(as_of)).alias("stop"))
    return expand_months(spans)


def carry_forward_spans(details: DataFrame, as_of: dt.date) -> DataFrame:
    """Each gift's amount with the month span over which it is the latest one.

    ``details`` has the latest change per (person, gift, month). A change stays in force
    until a later month brings a higher sequence; sequences need not rise with months,
    so the state in force is the running maximum, not simply the previous row.
    """
    state = F.struct("sequence", "payment_type", "annual_amount")
    ordered = Window.partitionBy(*PERSON_GIFT).orderBy("month", "sequence")
    now = m.as_of_index(as_of)
    # Of rows that share a month, all but the last have an empty span and drop out.
    return (
        details.select(
            *PERSON_GIFT,
            m.index_of(F.col("month")).alias("start"),
            F.lead("month").over(ordered).alias("_next"),
            F.max(state).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_state"),
        )
        .select(
            *PERSON_GIFT,
            "_state.payment_type",
            "_state.annual_amount",
            "_state.sequence",
            "start",
            F.least(F.coalesce(m.index_of(F.col("_next")), F.lit(now)), F.lit(now)).alias("stop"),
        )
        .filter("start < stop")
    )


# Statuses that end a gift when cancelled gifts are cut from the file size.
ENDED_STATUSES = ["Terminated", "Canceled", "Completed", "No Gift Status"]


def cut_cancelled(w, spans: DataFrame, as_of: dt.date) -> DataFrame:
    """Carried amounts up to the month before their gift was cancelled.

    An ended gift without a status record counts as cancelled in the current month; one
    with an undated record as cancelled long ago.
    """
    status_day = w.calendar.select(F.col("date").alias("status_date"), F.col("month").alias("_month"))
    dated = w.gift_status_date.select("gift_system_id", "status_date", F.lit(True).alias("_recorded")).join(
        status_day, "status_date", "left"
    )
    month = (
        F.when(F.col("_recorded").isNull(), m.as_of_month(as_of))
        .when(F.col("status_date").isNull(), LONG_AGO)
        .otherwise(F.col("_month"))
    )
    ended = w.gift_status.filter(text.one_of(F.col("gift_status"), ENDED_STATUSES)).select("gift_status_id")
    cancelled = (
        w.regular_gift
        .join(ended, "gift_status_id")
        .join(dated, "gift_system_id", "left")
        .select("gift_id", month.alias("_cancelled"))
    )
    return (
        spans.join(cancelled, "gift_id", "left")
        .withColumn("stop", F.least("stop", F.coalesce(m.index_of(F.col("_cancelled")), "stop")))
        .drop("_cancelled")
        .filter("start < stop")
    )


def carry_forward_amounts(details: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per (person, gift, month): the amount in force at that month end."""
    return expand_months(carry_forward_spans(details, as_of)).select(
        *PERSON_GIFT, "month", "payment_type", "annual_amount", "sequence"
    )


def active_value_by_payment_type(details: DataFrame, as_of: dt.date) -> DataFrame:
    """Gifts and annual value in force per month and payment type."""
    return span_totals(
        carry_forward_spans(details, as_of), ["payment_type"], {"annual_value": "annual_amount"}, {"gifts": F.lit(1)}
    )


def gift_lifespan(w) -> DataFrame:
    """Set-up month, cancellation month and last month end at which a gift was active.

    Undated inactive gifts take the month in which the gift was last changed. A held gift
    has no cancellation month but may have a final active month.
    """
    gifts = w.regular_gift.select(
        "gift_id", "gift_system_id", "constituent_key", "gift_status_id", "gift_date", "changed_date_key"
    )
    days = w.calendar.select(F.col("date"), F.col("month"))
    set_up = days.select(F.col("date").alias("gift_date"), F.col("month").alias("setup_month"))
    status_day = days.select(F.col("date").alias("status_date"), F.col("month").alias("status_month"))
    dated = w.gift_status_date.select("gift_system_id", "status_date").join(status_day, "status_date", "left")
    months = w.months.select(F.col("month").alias("_month"), F.col("months_since"))

    live = text.one_of(F.col("gift_status"), ["Active", "Held"])
    changed = F.when(~live & F.col("status_month").isNull(), m.month_of_key(F.col("changed_date_key"))).otherwise(
        F.col("status_month")
    )
    base = (
        gifts.join(w.constituent.select("constituent_key", "constituent_id"), "constituent_key")
        .join(w.gift_status.select("gift_status_id", "gift_status"), "gift_status_id")
        .join(dated.select("gift_system_id", "status_month"), "gift_system_id", "left")
        .join(set_up, "gift_date", "left")
        .withColumn("changed_month", changed)
    )
    since = months.select(F.col("_month").alias("changed_month"), F.col("months_since").alias("_since"))
    final = months.select(F.col("_month").alias("_final_month"), (F.col("months_since") - 1).alias("_since"))
    return (
        base.join(since, "changed_month", "left")
        .join(final, "_since", "left")
        .select(
            "constituent_id",
            "gift_id",
            "gift_status",
            "setup_month",
            F.when(live, None).otherwise(F.col("changed_month")).alias("cancel_month"),
            F.when(text.same(F.col("gift_status"), "Active"), None)
            .otherwise(F.col("_final_month"))
            .alias("final_active_month"),
        )
    )


def totals_by_change(wide: DataFrame) -> DataFrame:
    """Each (person, gift, month, group, payment type, sequence) once, with the total of all amounts of its (gift, sequence).

    A change that appears under several groups, or several times in one, is looked up by (gift, sequence) from each of them with
    every row it has. Where only totals matter, one row with their sum says the same. Changes without a gift or a sequence,
    which no lookup finds, are left out.
    """
    total = F.sum("change_annual_amount").over(Window.partitionBy("gift_id", "sequence")).alias("change_annual_amount")
    keys = [*PERSON_GIFT, "month", "group_id", "payment_type_id", "sequence"]
    found = wide.filter("gift_id is not null and sequence is not null").select(*keys, total)
    return found.groupBy(*keys).agg(F.first("change_annual_amount").alias("change_annual_amount"))


def latest_change_per_group_month(w, wide: DataFrame, totalled: bool = False) -> DataFrame:
    """Change amount at the highest sequence of each (person, gift, month, group).

    The amount is looked up by (gift, sequence), so a change that appears under several
    groups counts in each of them with every row it has. With ``totalled`` the rows are those of
    :func:`totals_by_change`, and a (person, gift, month, group) has one row with the sum for each payment type.
    """
    keys = [*PERSON_GIFT, "month", "group_id"]
    if totalled:
        # Sequences are distinct here, so one row is left; all others leave before the shuffle.
        top = Window.partitionBy(*keys, "payment_type_id").orderBy(F.col("sequence").desc())
        found = wide.withColumn("_rank", F.rank().over(top)).filter("_rank <= 1").drop("_rank")
    else:
        latest = wide.groupBy(*keys, "payment_type_id").agg(F.max("sequence").alias("sequence"))
        amounts = wide.select("gift_id", "sequence", "change_annual_amount")
        found = latest.join(amounts, ["gift_id", "sequence"])
    return _with_payment_type(w, found).select(*keys, "sequence", "payment_type", "change_annual_amount")


def group_spans(w, details: DataFrame, as_of: dt.date) -> DataFrame:
    """Each change with the months it counts in: from its own to the month before cancellation."""
    status_day = w.calendar.select(F.col("date").alias("status_date"), F.col("month").alias("_cancelled"))
    ended = text.one_of(F.col("status"), ["Terminated", "Canceled", "Completed"])
    cancelled = (
        w.gift_status_date.filter(ended)
        .join(status_day, "status_date", "left")
        .withColumn("_cancelled", F.when(F.col("status_date").isNull(), LONG_AGO).otherwise(F.col("_cancelled")))
        .join(w.gift.select("gift_system_id", "gift_id"), "gift_system_id")
        .select("gift_id", "_cancelled")
    )
    now = F.lit(m.as_of_index(as_of))
    return (
        details.join(cancelled, "gift_id", "left")
        .select(
            *PERSON_GIFT,
            "group_id",
            "change_annual_amount",
            m.index_of(F.col("month")).alias("start"),
            F.least(F.coalesce(m.index_of(F.col("_cancelled")), now), now).alias("stop"),
        )
        .filter("start < stop")
    )


def active_gift_value_by_group(w, details: DataFrame, as_of: dt.date) -> DataFrame:
    """Distinct givers, distinct gifts and cumulative value per month and group.

    Distinct counts need no gift-month rows: the months in which a giver (or gift) is
    present form merged spans, and each merged span adds one from start to stop. Givers, gifts and value each read the
    spans, so these are settled: the details meet the cancellations once.
    """
    return totals_by_group(settle(group_spans(w, details, as_of)))


def totals_by_group(spans: DataFrame) -> DataFrame:
    """Givers, gifts and value per month and group of the spans of :func:`group_spans`."""
    none, one = F.lit(0), F.lit(1)
    value = spans.select("group_id", "start", "stop", F.col("change_annual_amount").alias("v"), none.alias("p"), none.alias("g"))
    people = merge_spans(spans.select("constituent_id", "group_id", "start", "stop"), ["constituent_id", "group_id"])
    gifts = merge_spans(spans.select("gift_id", "group_id", "start", "stop"), ["gift_id", "group_id"])
    no_value = F.lit(None).cast("decimal(19,4)").alias("v")
    marks = value.unionByName(people.select("group_id", "start", "stop", no_value, one.alias("p"), none.alias("g"))).unionByName(
        gifts.select("group_id", "start", "stop", no_value, none.alias("p"), one.alias("g"))
    )
    return span_totals(marks, ["group_id"], {"value": "v"}, {"givers": "p", "gifts": "g"}).select(
        "month", "group_id", "givers", "gifts", "value"
    )
