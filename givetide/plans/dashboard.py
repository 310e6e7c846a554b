"""Dashboard run: monthly metrics, targets, year to date and long-term trends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from givetide.operators.actions import event_signups, event_signups_filled, pack_sends, pack_sends_filled
from givetide.operators.fill import fill_missing_fiscal_months
from givetide.operators.history import rule_history
from givetide.operators.metrics import monthly_metrics
from givetide.operators.targets import compare_to_targets, future_targets, long_term_trends, ytd_results
from givetide.sources.warehouse import Warehouse, one_run, replace_table, settle

Write = Callable[[DataFrame, str], None]


def filled_metrics(w: Warehouse) -> DataFrame:
    """Monthly metrics with zero rows for the missing months of each fiscal year."""
    monthly = settle(monthly_metrics(w, settle(rule_history(w, counted=True)), w.as_of))
    return settle(monthly.unionByName(fill_missing_fiscal_months(monthly, w.months, w.group)))


def working_rows(w: Warehouse, metrics: DataFrame) -> DataFrame:
    """Metrics against targets, with the targets of future months appended."""
    compared = settle(compare_to_targets(metrics, w.target, w.months, w.as_of))
    return settle(compared.unionByName(future_targets(compared, w.target, w.months)))


def run(w: Warehouse, stored_at: dt.datetime, write: Write | None = None) -> None:
    """Replace the four dashboard tables.

    Each intermediate that several steps read is settled once: the rule history, the
    metrics, and the target comparison.
    """
    with one_run(w, "older"):
        metrics = filled_metrics(w)
        replace_table(event_signups_filled(w, event_signups(w), w.as_of), "event_signups", write, w.names)
        replace_table(pack_sends_filled(w, pack_sends(w), w.as_of), "pack_sends", write, w.names)
        replace_table(ytd_results(working_rows(w, metrics), w.target, w.months, w.as_of), "ytd_results", write, w.names)
        replace_table(long_term_trends(metrics, w.months, stored_at), "long_term_trends", write, w.names)
