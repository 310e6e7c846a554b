"""One registered query per operator, over the order tables in their warehouse roles.

Each callable takes (spark, directory) and returns a DataFrame. Money is exact until the
last step, where it becomes double so that it compares across engines.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from givetide.functions import months as m
from givetide.operators import actions, calendar, constraints, filesize, fill, groups, history, income, metrics, rollup, state, targets
from givetide.operators.spans import expand_months
from givetide.plans import dashboard, file_size, rebuild
from givetide.sources.results import Results
from givetide.sources.roles import AS_OF, warehouse_of
from givetide.sources.schemas import RESULTS
from givetide.sources.warehouse import run_folder, settle

STORED_AT = dt.datetime(2001, 9, 15, 6, 0, 0)

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Money as double, so that it compares across engines; quotients of money to six places first."""

    def column(f):
        if not isinstance(f.dataType, DecimalType):
            return F.col(f.name)
        return (F.round(f.name, 6) if f.dataType.scale > 6 else F.col(f.name)).cast("double").alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def registered(fn: Callable) -> Callable:
    REGISTERED[fn.__name__] = lambda spark, directory: plain(fn(warehouse_of(spark, directory)))
    return fn


def _history(w) -> DataFrame:
    return history.rg_history(w, carry=True)


def _details(w) -> DataFrame:
    """Latest change per gift and month, from the changes alone."""
    return file_size.details(w)


@registered
def month_spine(w):
    """Months in which an order was placed or a line shipped."""
    days = w.payment.select(F.col("donation_date_key").alias("date_key")).unionByName(
        w.gift_change.select(F.col("change_date_key").alias("date_key"))
    )
    return calendar.month_spine(w.calendar.join(days.distinct(), "date_key", "left_semi"))


@registered
def upgrade_appeals(w):
    return history.upgrade_appeals(w.appeal, w.campaign)


@registered
def rolling_sms_appeals(w):
    return history.rolling_sms_appeals(w.package)


@registered
def descriptor(w):
    return w.appeal.select(
        "appeal_id",
        "appeal_category",
        "campaign_description",
        history.descriptor(F.col("appeal_category"), F.col("campaign_description")).alias("descriptor"),
    )


@registered
def rg_history(w):
    return history.rg_history(w)


@registered
def appeal_type(w):
    return history.appeal_types(w.appeal, w.campaign)


@registered
def new_gift_facts(w):
    return history.new_gift_facts(w, history.rule_history(w))


@registered
def amendment_facts(w):
    return history.amendment_facts(w, history.rule_history(w))


@registered
def cancellation_facts(w):
    return history.cancellation_facts(w, history.rule_history(w))


@registered
def cash_gift_facts(w):
    return income.cash_gift_facts(w)


@registered
def event_signups(w):
    return actions.event_signups(w)


@registered
def pack_sends(w):
    return actions.pack_sends(w)


@registered
def event_signups_filled(w):
    return actions.event_signups_filled(w, actions.event_signups(w), AS_OF)


@registered
def pack_sends_filled(w):
    return actions.pack_sends_filled(w, actions.pack_sends(w), AS_OF)


@registered
def zero_fill_since_first(w):
    """Months since their first payment in which a supporter paid nothing."""
    paid = w.payment.select("constituent_key", m.month_of_key(F.col("donation_date_key")).alias("month"))
    return fill.zero_fill_since_first(paid, ["constituent_key"], m.as_of_index(AS_OF)).withColumn("total", F.lit(0))


@registered
def latest_state_per_month(w):
    return state.latest_state_per_month(w, _history(w))


@registered
def unrealistic_gifts(w):
    return state.unrealistic_gifts(w)


@registered
def every_month_since_start(w):
    return state.every_month_since_start(w, history.regular_gift_changes(w), AS_OF)


@registered
def carry_forward_amounts(w):
    return state.carry_forward_amounts(_details(w), AS_OF)


@registered
def carry_forward_uncancelled(w):
    kept = state.cut_cancelled(w, state.carry_forward_spans(_details(w), AS_OF), AS_OF)
    return expand_months(kept).select("constituent_id", "gift_id", "month", "payment_type", "annual_amount", "sequence")


@registered
def active_value_by_payment_type(w):
    return state.active_value_by_payment_type(_details(w), AS_OF)


@registered
def gift_lifespan(w):
    return state.gift_lifespan(w)


def _retention(w) -> DataFrame:
    return filesize.retention_long(*file_size.carried_and_lifespans(w))


@registered
def retention_long(w):
    return _retention(w)


@registered
def retention_by_mandate_age(w):
    return filesize.retention_by_mandate_age(w, settle(_retention(w)))


@registered
def rolling_24_month_cash(w):
    return filesize.rolling_24_month_cash(w, AS_OF)


def _giver_status(w) -> DataFrame:
    return filesize.giver_status(filesize.regular_giving_spans(*file_size.carried_and_lifespans(w)), filesize.rolling_cash_spans(w, AS_OF))


@registered
def giver_status(w):
    return filesize.per_month(_giver_status(w))


@registered
def exclude_organisations(w):
    return filesize.per_month(filesize.exclude_organisations(w, _giver_status(w)))


def _individuals(w) -> DataFrame:
    return settle(filesize.giver_status_of(w, *file_size.carried_and_lifespans(w), AS_OF))


@registered
def mark_deceased(w):
    return filesize.per_month(_individuals(w))


@registered
def file_size_actuals(w):
    return filesize.file_size_actuals(_individuals(w))


@registered
def crossed_giving(w):
    return filesize.crossed_giving(w, _individuals(w), AS_OF)


def _classified_regular(w, variant: str, facts) -> DataFrame:
    return groups.classify_regular(variant, facts(w, history.rule_history(w)), w.known_descriptor).select("gift_id", "month", "descriptor", "value", "group_id")


@registered
def classify_regular_new(w):
    return _classified_regular(w, "NEW", history.new_gift_facts)


@registered
def classify_regular_change(w):
    return _classified_regular(w, "CHANGE", history.amendment_facts)


@registered
def classify_regular_cancel(w):
    return _classified_regular(w, "CANCEL", history.cancellation_facts)


@registered
def classify_regular_wide(w):
    return history.grouped_changes(w).select("gift_id", "sequence", "month", "change_annual_amount", "group_id")


@registered
def classify_cash(w):
    ruled = groups.classify_cash(income.cash_gift_facts(w), w.known_descriptor)
    return ruled.select("gift_id", "month", "descriptor", "amount", "group_id")


@registered
def classify_rg_income(w):
    return groups.classify_rg_income(w.rg_income)


@registered
def classify_event(w):
    return groups.classify_event(actions.event_signups(w))


@registered
def classify_pack(w):
    return groups.classify_pack(actions.pack_sends(w))


def _metrics(w) -> DataFrame:
    return metrics.monthly_metrics(w, settle(history.rule_history(w, counted=True)), AS_OF)


_filled = dashboard.filled_metrics


def _working(w) -> DataFrame:
    return dashboard.working_rows(w, _filled(w))


@registered
def monthly_metrics(w):
    return _metrics(w)


@registered
def fill_missing_fiscal_months(w):
    return fill.fill_missing_fiscal_months(settle(_metrics(w)), w.months, w.group)


@registered
def compare_to_targets(w):
    return targets.compare_to_targets(_filled(w), w.target, w.months, AS_OF)


@registered
def future_targets(w):
    compared = settle(targets.compare_to_targets(_filled(w), w.target, w.months, AS_OF))
    return targets.future_targets(compared, w.target, w.months)


@registered
def zero_income_ytd_targets(w):
    return targets.zero_income_ytd_targets(_working(w), w.target, w.months)


@registered
def ytd_results(w):
    return targets.ytd_results(_working(w), w.target, w.months, AS_OF)


@registered
def long_term_trends(w):
    return targets.long_term_trends(_filled(w), w.months, STORED_AT)


@registered
def widened_history(w):
    return history.widened_history(w, _history(w)).drop("payment_type_id", "audience_id", "gift_status_id", "gift_system_id")


def _by_group(w) -> DataFrame:
    return state.latest_change_per_group_month(w, settle(history.grouped_changes(w)))


@registered
def latest_change_per_group_month(w):
    return _by_group(w)


@registered
def active_gift_value_by_group(w):
    return state.active_gift_value_by_group(w, settle(_by_group(w)), AS_OF)


@registered
def pack_requests_vs_target(w):
    return targets.pack_requests_vs_target(w)


@registered
def faith_groups_vs_target(w):
    return targets.faith_groups_vs_target(w)


@registered
def faith_group_payments(w):
    return targets.faith_group_payments(w)


@registered
def last_appeal_attribution(w):
    return history.last_appeal_attribution(w, ["14", "15"])


@registered
def metrics_by_level(w):
    return rollup.metrics_by_level(_metrics(w), w.group.unionByName(w.upper_group))


@registered
def active_gifts_by_level(w):
    return rollup.active_gifts_by_level(w, settle(_by_group(w)), w.group.unionByName(w.upper_group), AS_OF)


@registered
def constraint_report(w):
    """The needed rules and names, and references and nulls of which some fail here."""
    some = [
        constraints.refers("gift_change", "appeal_id", "appeal"),
        constraints.refers("gift_change", "package_id", "package"),
        constraints.refers("gift", "audience_id", "audience"),
        constraints.filled("gift", "appeal_id"),
        constraints.filled("gift", "gift_system_id"),
        constraints.unique("gift", "constituent_key", "gift_date_key"),
    ]
    return constraints.constraint_report(w, [*constraints.NEEDED, *constraints.NAMES, *some])


@registered
def fiscal_year_totals(w):
    return targets.fiscal_year_totals(settle(_metrics(w)), w.months)


#: The month from which published results are rebuilt, and the number of months that have a snapshot.
REBUILT, SNAPSHOTS = 200010, 12


def _rebuilt(w, run, table: str, **options):
    """A table published by a full run and then rebuilt from a month on, read over all months."""
    spark = w.calendar.sparkSession
    results = Results(spark, f"{run_folder(spark)}/results-{uuid.uuid4().hex}")
    run(w, results, snapshots=SNAPSHOTS, **options)
    run(w, results, from_month=REBUILT, snapshots=1, **options)
    return results.read(RESULTS[table])


@registered
def file_size_rebuilt(w):
    return _rebuilt(w, rebuild.file_size, "file_size_actuals", only=["file_size_actuals"])


@registered
def active_gifts_rebuilt(w):
    return _rebuilt(w, rebuild.active_gifts, "active_gift_value_by_group")
