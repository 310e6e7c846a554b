"""Active-gift run: givers, gifts and value at each month end per reporting group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from givetide.operators.constraints import require
from givetide.operators.history import grouped_changes
from givetide.operators.state import active_gift_value_by_group, latest_change_per_group_month
from givetide.sources.warehouse import Warehouse, one_run, replace_table, settle


def run(w: Warehouse, write: Callable[[DataFrame, str], None] | None = None, check: bool = False) -> None:
    """Replace the table of active gifts by group.

    The grouped changes are read twice (latest sequence, and the amount at it), so they
    are settled first. ``check`` raises an error if the tables break a constraint that the operators need.
    """
    with one_run(w, "older"):
        if check:
            require(w)
        details = settle(latest_change_per_group_month(w, settle(grouped_changes(w))))
        replace_table(active_gift_value_by_group(w, details, w.as_of), "active_gift_value_by_group", write, w.names)
