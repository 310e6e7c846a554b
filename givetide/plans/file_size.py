"""File-size run: retention by mandate age, supporters by category, crossed giving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from givetide.operators.constraints import require
from givetide.operators.filesize import (
    crossed_giving,
    file_size_actuals,
    giver_status_of,
    retention_by_mandate_age,
    retention_long,
)
from givetide.operators.history import regular_gift_changes
from givetide.operators.state import (
    carry_forward_spans,
    gift_lifespan,
    latest_state_per_month,
    unrealistic_gifts,
    without_gifts,
)
from givetide.sources.warehouse import Warehouse, one_run, replace_table, settle


def details(w: Warehouse, unwanted: DataFrame | None = None) -> DataFrame:
    """Latest change per gift and month, from the changes alone, without unrealistic gifts."""
    unwanted = unrealistic_gifts(w, w.regular_gift) if unwanted is None else unwanted
    return without_gifts(latest_state_per_month(w, regular_gift_changes(w)), unwanted)


def carried_and_lifespans(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Settled amounts in force per gift, as spans, and the settled lifespans.

    Unrealistic gifts are left out once, before anything is carried forward.
    """
    unwanted = settle(unrealistic_gifts(w, w.regular_gift))
    return settle(carry_forward_spans(details(w, unwanted), w.as_of)), settle(without_gifts(gift_lifespan(w), unwanted))


def run(w: Warehouse, write: Callable[[DataFrame, str], None] | None = None, check: bool = False) -> None:
    """Replace the three file-size tables; ``check`` raises an error if the tables break a constraint that the operators need."""
    with one_run(w, "older"):
        if check:
            require(w)
        carried, lifespans = carried_and_lifespans(w)
        replace_table(retention_by_mandate_age(w, settle(retention_long(carried, lifespans))), "retention_by_mandate_age", write, w.names)
        status = settle(giver_status_of(w, carried, lifespans, w.as_of))
        replace_table(file_size_actuals(status), "file_size_actuals", write, w.names)
        replace_table(crossed_giving(w, status, w.as_of), "crossed_giving", write, w.names)
