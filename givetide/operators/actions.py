"""Event sign-ups and pack sends, from supporter actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.functions import text
from givetide.operators.fill import zero_fill_since_first
from givetide.operators.groups import classify_event, classify_pack
from givetide.sources.warehouse import settle

# Action statuses that make a sign-up.
SIGNED_UP = ["Participating", "Accepted", "Participated", "Pending Approval", "Day of event"]

MONTH_COLUMNS = ["calendar_year", "fiscal_year", "month_name", "months_since"]


def _actions(w, statuses: list[str], type_part: str) -> DataFrame:
    wanted_status = w.action_status.filter(text.one_of(F.col("action_status"), statuses))
    wanted_type = w.action_type.filter(text.contains(F.col("action_type"), type_part))
    return w.action.join(wanted_status.select("action_status_id", "action_status"), "action_status_id").join(
        wanted_type.select("action_type_id", "action_type"), "action_type_id"
    )


def _past_days(w, date: str, *extra: str) -> DataFrame:
    days = w.calendar.filter("months_since > -1")
    return days.select(F.col("date").alias(date), F.col("month"), *extra)


# Categories of the action attributes that describe a sign-up, and what stands for a missing one.
EVENT_ATTRIBUTES = {
    "event_name": ("Event Name", None),
    "registration_type": ("Event Registration Type", "Neither"),
    "event_type": ("Event Category", "Other"),
    "platform": ("Fundraising Platform Used", ""),
}


def _event_attributes(w) -> DataFrame:
    """Action -> its event name, registration, category and platform, from one reading of the attributes.

    An action with several attributes of a category has a row for each, with every combination of categories. Their
    number is that of one action's attributes, so gathering them per action is bounded.
    """
    category, value = F.col("attribute_category"), F.col("attribute_description")
    wanted = w.action_attribute.filter(text.one_of(category, [c for c, _ in EVENT_ATTRIBUTES.values()]))
    lists = [F.collect_list(F.when(text.same(category, c), F.struct(value.alias("value")))).alias(name) for name, (c, _) in EVENT_ATTRIBUTES.items()]
    found = wanted.groupBy("action_id").agg(*lists)
    for name, (_, missing) in EVENT_ATTRIBUTES.items():
        found = found.withColumn(name, F.explode_outer(name)).withColumn(name, F.coalesce(F.col(name)["value"], F.lit(missing)))
    return found.filter("event_name is not null")


def event_signups(w) -> DataFrame:
    """Sign-ups per event, month added, registration, category, platform and event date.

    Spellings of an event's name that differ in case or trailing blanks only are one event, under the least of them.
    """
    event_days = w.calendar.select(F.col("date_key").alias("action_date_key"), F.col("calendar_year").alias("event_year"))
    signups = (
        _actions(w, SIGNED_UP, "FR Event - ")
        .join(w.action_extra.select("action_system_id", "date_added"), "action_system_id")
        .join(_past_days(w, "date_added"), "date_added")
        .join(event_days, "action_date_key")
        .join(w.constituent.select("constituent_key", "constituent_id"), "constituent_key")
        .select("action_id", "constituent_id", "month", "event_year", F.col("action_date_key").alias("event_date_key"), "action_type")
    )
    keys = ["event_year", "month", "event_name", "registration_type", "event_type", "platform", "action_type", "event_date_key"]
    counted = signups.join(_event_attributes(w), "action_id").groupBy(*keys).agg(F.count("constituent_id").alias("n"))
    # Counts, not sign-ups, meet in the window: at most one row per key.
    one_name = F.min("event_name").over(Window.partitionBy(text.fold(F.col("event_name"))))
    return counted.withColumn("event_name", one_name).groupBy(*keys).agg(F.sum("n").alias("signups"))


def constituent_types(w, people: DataFrame) -> DataFrame:
    """School, faith group or neither, for the given people.

    A person with several codes has several types.
    """
    code = F.col("constituent_code")
    kind = (
        F.when(text.same(code, "Schools"), "School").when(text.same(code, "Faith Groups"), "Faith Group").otherwise("Neither")
    )
    return (
        people.select("constituent_id")
        .distinct()
        .join(w.constituent.select("constituent_key", "constituent_id"), "constituent_id")
        .join(w.constituent_code.select("constituent_key", "constituent_code"), "constituent_key", "left")
        .select("constituent_id", kind.alias("constituent_type"))
        .distinct()
    )


def pack_sends(w) -> DataFrame:
    """Packs sent, counted once per person, day, action type and person type."""
    keys = ["fiscal_year", "month", "action_type", "constituent_type"]
    sends = (
        _actions(w, ["Sent"], "FR Pack - ")
        .join(_past_days(w, "action_date", "fiscal_year"), "action_date")
        .join(w.constituent.select("constituent_key", "constituent_id"), "constituent_key")
        .select("constituent_id", "month", "action_date_key", "fiscal_year", "action_status", "action_type")
        .distinct()
    )
    return (
        sends.join(constituent_types(w, sends), "constituent_id")
        .groupBy(*keys)
        .agg(F.count("constituent_id").alias("sends"))
    )


def _with_groups_and_months(w, df: DataFrame, keys: list[str], total: Column, name: str) -> DataFrame:
    groups = w.group.select("group_id", "description")
    months = w.months.select("month", *MONTH_COLUMNS)
    return (
        df.join(groups, "group_id", "left")
        .join(months, "month")
        .groupBy("type", "month", "group_id", "forms_part_of", "level", "description", *keys, *MONTH_COLUMNS)
        .agg(total.alias(name))
    )


def _zero_filled(w, df: DataFrame, keys: list[str], name: str, as_of: dt.date) -> DataFrame:
    df = settle(df)  # read twice: as they are, and for the months they lack
    full = ["type", "group_id", "forms_part_of", "level", "description", *keys]
    months = w.months.select("month", *MONTH_COLUMNS)
    empty = zero_fill_since_first(df, full, m.as_of_index(as_of)).join(months, "month").withColumn(name, F.lit(0).cast("long"))
    return df.unionByName(empty)


def event_signups_filled(w, signups: DataFrame, as_of: dt.date) -> DataFrame:
    """Classified sign-ups per event and month, with zero rows since each event's first."""
    keys = ["event_name", "event_month"]
    classified = classify_event(signups).withColumn("type", F.lit("SignUpsDuringMonth")).withColumn(
        "event_month", m.month_of_key(F.col("event_date_key"))
    )
    counted = _with_groups_and_months(w, classified, keys, F.sum("signups"), "signups")
    return _zero_filled(w, counted, keys, "signups", as_of)


def pack_sends_filled(w, sends: DataFrame, as_of: dt.date) -> DataFrame:
    """Classified pack sends per action type and month, with zero rows since the first."""
    keys = ["action_type"]
    classified = classify_pack(sends.drop("fiscal_year")).withColumn("type", F.lit("ReceivedPackDuringMonth"))
    counted = _with_groups_and_months(w, classified, keys, F.sum("sends"), "sends")
    return _zero_filled(w, counted, keys, "sends", as_of)
