"""Retention by mandate age, supporter file size, and giving crossed with category."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.functions import text
from givetide.operators.spans import expand_months, merge_spans, span_steps, span_totals

CASH_MONTHS = 24
DECEASED = "Deceased - was "


def retention_long(spans: DataFrame, lifespans: DataFrame) -> DataFrame:
    """People, gifts and amount per month, payment type, set-up and cancellation month.

    ``spans`` are carried-forward amounts. Gifts that never reach a month stay in, with a
    NULL month, as do amounts of gifts without a lifespan.
    """
    keys = ["payment_type", "setup_month", "cancel_month"]
    lives = lifespans.select("gift_id", "setup_month", "cancel_month")
    both = spans.withColumn("_found", F.lit(True)).join(lives, "gift_id", "full")
    found = both.filter("_found")
    none, one = F.lit(0), F.lit(1)
    rows = found.select(*keys, "start", "stop", F.col("annual_amount").alias("v"), none.alias("p"), one.alias("g"))
    people = merge_spans(found.select("constituent_id", *keys, "start", "stop"), ["constituent_id", *keys]).select(
        *keys, "start", "stop", F.lit(None).cast("decimal(19,4)").alias("v"), one.alias("p"), none.alias("g")
    )
    monthly = span_totals(rows.unionByName(people), keys, {"annual_amount": "v"}, {"constituents": "p", "gifts": "g"})
    absent = (
        both.filter("_found is null")
        .select(*keys)
        .distinct()
        .select(
            *keys,
            F.lit(None).cast("int").alias("month"),
            F.lit(0).cast("long").alias("constituents"),
            F.lit(0).cast("long").alias("gifts"),
            F.lit(None).cast("decimal(19,4)").alias("annual_amount"),
        )
    )
    return monthly.unionByName(absent).select("month", *keys, "constituents", "gifts", "annual_amount")


def retention_by_mandate_age(w, retention: DataFrame) -> DataFrame:
    """Re-sum by cancellation status and months since the mandate was set up.

    People were counted per finer key, so a person may count more than once here.
    """
    since = lambda name, out: w.months.select(F.col("month").alias(name), F.col("months_since").alias(out))
    ahead = F.col("_cancelled") - F.col("_now")
    return (
        retention.join(since("cancel_month", "_cancelled"), "cancel_month", "left")
        .join(since("month", "_now"), "month", "left")
        .join(since("setup_month", "_set_up"), "setup_month", "left")
        .select(
            "month",
            "payment_type",
            F.when(ahead < 0, "Cancelled in future")
            .when(ahead == 0, "Cancelled DURING this month")
            .when(ahead.isNull(), "Still active now")
            .otherwise("Cancelled BEFORE this month")
            .alias("cancellation_status"),
            (F.col("_set_up") - F.col("_now")).cast("int").alias("months_since_setup"),
            "constituents",
            "gifts",
            "annual_amount",
        )
        .groupBy("month", "payment_type", "cancellation_status", "months_since_setup")
        .agg(
            F.sum("constituents").alias("constituents"),
            F.sum("gifts").alias("gifts"),
            F.sum("annual_amount").alias("annual_amount"),
        )
    )


def monthly_cash(w) -> DataFrame:
    """Flagged cash per person and month."""
    days = w.calendar.select(F.col("date").alias("gift_date"), "month")
    return (
        w.cash_given.filter(text.same(F.col("is_counted"), "Yes"))
        .join(days, "gift_date")
        .groupBy("constituent_id", "month")
        .agg(F.sum("gift_amount").alias("given"))
    )


def rolling_cash_spans(w, as_of: dt.date) -> DataFrame:
    """Each month's cash with the 24 months it counts in, complete months only."""
    start = m.index_of(F.col("month"))
    return monthly_cash(w).select(
        "constituent_id",
        "given",
        start.alias("start"),
        F.least(start + CASH_MONTHS, F.lit(m.as_of_index(as_of))).alias("stop"),
    )


def rolling_24_month_cash(w, as_of: dt.date) -> DataFrame:
    """Cash per person over each complete month and the 23 before it."""
    return span_totals(rolling_cash_spans(w, as_of), ["constituent_id"], {"cash_24_months": "given"})


def regular_giving_spans(spans: DataFrame, lifespans: DataFrame) -> DataFrame:
    """Carried amounts, cut at the last month end at which their gift was active."""
    lives = lifespans.select("gift_id", "final_active_month")
    until = F.least(F.col("stop"), F.coalesce(m.index_of(F.col("final_active_month")) + 1, F.col("stop")))
    return spans.join(lives, "gift_id").select("constituent_id", "annual_amount", "start", until.alias("stop"))


def giver_status(regular: DataFrame, cash: DataFrame) -> DataFrame:
    """Both values and the giver category per person, over spans of equal months.

    Regular and cash spans are totalled together, which takes the place of joining the
    two by person and month. The result has one row per change of a person's totals;
    ``expand_months`` gives the row per month.
    """
    nothing = F.lit(None).cast("decimal(38,4)")
    rows = regular.select("constituent_id", "start", "stop", F.col("annual_amount").cast("decimal(38,4)").alias("r"), nothing.alias("c"))
    rows = rows.unionByName(
        cash.select("constituent_id", "start", "stop", nothing.alias("r"), F.col("given").cast("decimal(38,4)").alias("c"))
    )
    rg, cg = F.col("regular_value"), F.col("cash_24_months")
    return (
        span_steps(rows, ["constituent_id"], {"regular_value": "r", "cash_24_months": "c"}, {})
        .filter(rg.isNotNull() | cg.isNotNull())
        .withColumn(
            "giver_category",
            F.when(rg.isNotNull() & cg.isNotNull(), "Active CoG and Active Cash")
            .when(rg.isNotNull(), "Active CoG only")
            .otherwise("Active Cash only"),
        )
    )


def per_month(status: DataFrame) -> DataFrame:
    """One row per person and month of a giver status."""
    return expand_months(status).select("constituent_id", "month", "regular_value", "cash_24_months", "giver_category")


def exclude_organisations(w, df: DataFrame) -> DataFrame:
    organisations = w.constituent.filter(text.same(F.col("key_indicator"), "O")).select("constituent_id")
    return df.join(organisations, "constituent_id", "left_anti")


def mark_deceased(w, status: DataFrame) -> DataFrame:
    """Prefix the category from the first month with a past day after the date of death.

    Without a date of death, the date of the last change to the person stands in.
    """
    past = w.calendar.filter("days_since > 0")
    first_day = past.agg(F.min("date")).scalar()
    last_day = past.agg(F.max("date")).scalar()
    day = F.col("_day")
    died = (
        w.constituent.filter(text.same(F.col("is_deceased"), "Yes") & text.same(F.col("key_indicator"), "I"))
        .select("constituent_id", F.date_add(F.coalesce("deceased_date", "date_changed"), 1).alias("_day"))
        .filter(day <= last_day)
        .groupBy("constituent_id")
        .agg(F.min("_day").alias("_day"))
        .select("constituent_id", m.month_of_date(F.greatest(day, first_day)).alias("_deceased"))
    )
    start, stop = F.col("start"), F.col("stop")
    died_at = F.coalesce(m.index_of(F.col("_deceased")), stop)
    pieces = F.array(
        F.struct(start.alias("start"), F.least(stop, died_at).alias("stop"), F.lit("").alias("prefix")),
        F.struct(F.greatest(start, died_at).alias("start"), stop.alias("stop"), F.lit(DECEASED).alias("prefix")),
    )
    return (
        status.join(died, "constituent_id", "left")
        .select("constituent_id", "regular_value", "cash_24_months", "giver_category", F.explode(pieces).alias("_p"))
        .filter("_p.start < _p.stop")
        .select(
            "constituent_id",
            "_p.start",
            "_p.stop",
            "regular_value",
            "cash_24_months",
            F.concat("_p.prefix", "giver_category").alias("giver_category"),
        )
    )


def file_size_actuals(status: DataFrame) -> DataFrame:
    """People and values per month and category, without a row per person and month."""
    return span_totals(
        status,
        ["giver_category"],
        {"regular_value": "regular_value", "cash_24_months": "cash_24_months"},
        {"people": F.lit(1)},
    ).select("month", "giver_category", "people", "regular_value", "cash_24_months")


def crossed_giving(w, status: DataFrame, as_of: dt.date) -> DataFrame:
    """Money given in each month, by the category the giver has at its end.

    Givers without a category that month keep a NULL one.
    """
    people = w.constituent.filter(text.same(F.col("key_indicator"), "I")).select("constituent_key", "constituent_id")
    days = w.calendar.select(F.col("date_key").alias("gift_date_key"), "month")
    counted = w.cash_gift.filter(text.same(F.col("is_counted"), "Yes")).select("gift_id")
    now = m.as_of_month(as_of)

    def given(gift_type: int, label: str, only: DataFrame | None) -> DataFrame:
        gifts = w.gift.filter(F.col("gift_type_id") == gift_type).select("gift_id", "constituent_key", "gift_date_key", "amount")
        gifts = gifts if only is None else gifts.join(only, "gift_id")
        return (
            gifts.join(days, "gift_date_key")
            .filter(F.col("month") < now)
            .groupBy("constituent_key", "month")
            .agg(F.sum("amount").alias("total"))
            .withColumn("gift_type", F.lit(label))
        )

    giving = (
        given(1, "Cash", counted)
        .unionByName(given(31, "RG Payment", None))
        .join(people, "constituent_key")
        .withColumn("_at", m.index_of(F.col("month")))
    )
    spans = status.select(F.col("constituent_id").alias("_person"), "start", "stop", "giver_category")
    at_month_end = (
        (F.col("constituent_id") == F.col("_person")) & (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("stop"))
    )
    return giving.join(spans, at_month_end, "left").groupBy("giver_category", "gift_type", "month").agg(F.sum("total").alias("total"))


def giver_status_of(w, spans: DataFrame, lifespans: DataFrame, as_of: dt.date) -> DataFrame:
    """Giver status of individuals, deceased marked, from the gift spans up."""
    status = giver_status(regular_giving_spans(spans, lifespans), rolling_cash_spans(w, as_of))
    return mark_deceased(w, exclude_organisations(w, status))
