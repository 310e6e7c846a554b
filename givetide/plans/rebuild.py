"""File size and active gifts rebuilt from a month on, from a snapshot of what was in force before it.

A run stores, besides its results, what every gift was worth at the start of the last few months. The next run may start
at one of these: it reads the changes, cash and payments from that month on (cash from 23 months before it, which its
first month still counts), and takes the rest from the snapshot. Earlier facts are not read, and earlier months of the
results stay as they are. Group values are stored as steps: only what came since the month of the snapshot before.

The months that are rebuilt equal those of a full run. What must hold for the earlier ones is that nothing changed in
them: changes that arrive late, and gifts that are cancelled with an earlier date, need a rebuild from their month.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.operators import filesize, state
from givetide.operators.history import grouped_changes, regular_gift_changes
from givetide.sources.results import Results
from givetide.sources.schemas import RESULTS
from givetide.sources.warehouse import Warehouse, one_run, settle, unsettle

OPEN_AMOUNTS = "OpenAmounts"
OPEN_GROUP_VALUES = "OpenGroupValues"
#: The months that have a snapshot in ``OPEN_GROUP_VALUES``, also those before which nothing came since the last one.
OPEN_GROUP_MONTHS = "OpenGroupMonths"
SNAPSHOTS = 3
FILE_SIZE = ("retention_by_mandate_age", "file_size_actuals", "crossed_giving")


def _index(month: int) -> int:
    return month // 100 * 12 + month % 100 - 1


def _month(index: int) -> int:
    return index // 12 * 100 + index % 12 + 1


def snapshot_months(w: Warehouse, from_month: int | None, number: int = SNAPSHOTS) -> list[int]:
    """The last months up to the current one, of those after the month that the run starts at."""
    now = m.as_of_index(w.as_of)
    return [_month(i) for i in range(now - number + 1, now + 1) if from_month is None or i > _index(from_month)]


def changes_from(w: Warehouse, month: int | None) -> Warehouse:
    """The warehouse without changes before a month; the condition is one on the stored date key."""
    return w if month is None else w.replace(gift_change=w.gift_change.filter(F.col("change_date_key") >= month * 100))


def _clipped(spans: DataFrame, month: int | None) -> DataFrame:
    if month is None:
        return spans
    return spans.withColumn("start", F.greatest("start", F.lit(_index(month)))).filter("start < stop")


def open_amounts(spans: DataFrame, months: Collection[int]) -> DataFrame:
    """The amount in force of every (person, gift) when each of the months began."""
    began = F.explode(F.array(*[F.lit(x) for x in months])).alias("month")
    last = m.index_of(F.col("month")) - 1
    columns = ["constituent_id", "gift_id", "sequence", "payment_type", "annual_amount"]
    return spans.select(*columns, "start", "stop", began).filter((F.col("start") <= last) & (last < F.col("stop"))).select(*columns, "month")


def carried_from(w: Warehouse, unwanted: DataFrame, month: int | None, before: DataFrame | None) -> DataFrame:
    """Spans of amounts in force from a month on: of all changes, or of the later ones and what was in force before."""
    details = state.latest_state_per_month(w, regular_gift_changes(changes_from(w, month)))
    if month is not None:
        entering = before.filter(F.col("month") == month).withColumn("month", F.lit(_month(_index(month) - 1)))
        details = details.unionByName(entering)
    return _clipped(state.carry_forward_spans(state.without_gifts(details, unwanted), w.as_of), month)


def cash_from(w: Warehouse, month: int | None) -> Warehouse:
    """The warehouse without cash that no month from the given one on counts."""
    if month is None:
        return w
    first = _month(_index(month) - filesize.CASH_MONTHS + 1)
    return w.replace(cash_gift=w.cash_gift.filter(F.col("gift_date") >= F.make_date(F.lit(first // 100), F.lit(first % 100), F.lit(1))))


def file_size(w: Warehouse, results: Results, from_month: int | None = None, only: Collection[str] = FILE_SIZE, snapshots: int = SNAPSHOTS) -> None:
    """Publish the file-size tables, all months or those from ``from_month`` on, with the snapshots for the next run.

    ``from_month`` must be a month whose snapshot an earlier run published.
    """
    before = None if from_month is None else _snapshot(results, OPEN_AMOUNTS, from_month)
    with one_run(w, "older"), results.publish() as write:
        unwanted = settle(state.unrealistic_gifts(w, w.regular_gift))
        carried = settle(carried_from(w, unwanted, from_month, before))
        lifespans = settle(state.without_gifts(state.gift_lifespan(w), unwanted))

        def put(table: str, rows: Callable[[], DataFrame]) -> None:
            if table in only:
                write.months(rows(), RESULTS[table], from_month)

        put("retention_by_mandate_age", lambda: filesize.retention_by_mandate_age(w, settle(filesize.retention_long(carried, lifespans))))
        if {"file_size_actuals", "crossed_giving"} & set(only):
            regular = filesize.regular_giving_spans(carried, lifespans)
            cash = _clipped(filesize.rolling_cash_spans(cash_from(w, from_month), w.as_of), from_month)
            status = settle(filesize.mark_deceased(w, filesize.exclude_organisations(w, filesize.giver_status(regular, cash))))
            put("file_size_actuals", lambda: filesize.file_size_actuals(status))
            later = w if from_month is None else w.replace(gift=w.gift.filter(F.col("gift_date_key") >= from_month * 100))
            put("crossed_giving", lambda: filesize.crossed_giving(later, status, w.as_of))
        if months := snapshot_months(w, from_month, snapshots):
            write.months(open_amounts(carried, months), OPEN_AMOUNTS, None if from_month is None else months[0])


def _snapshot(results: Results, table: str, month: int) -> DataFrame:
    found = results.read(table, month, _month(_index(month) + 1))
    if found.isEmpty():
        raise ValueError(f"there is no snapshot of {month} to rebuild from")
    return found


def open_group_values(details: DataFrame, months: Collection[int]) -> DataFrame:
    """What every (person, gift) brought to each group before each of the months, whether cancelled or not, since the one before it.

    A change stands under the first of the months that began after it, and so once, however many of them there are. What
    had been brought when one of the months began is the sum of its rows and those of the months before it.
    """
    columns = ["constituent_id", "gift_id", "group_id"]
    began = F.array_min(F.filter(F.array(*[F.lit(x) for x in months]), lambda x: x > F.col("month"))).alias("month")
    rows = details.select(*columns, began, "change_annual_amount").filter("month is not null")
    return rows.groupBy(*columns, "month").agg(F.sum("change_annual_amount").cast("decimal(38,4)").alias("change_annual_amount"))


def _entering_group_values(results: Results, month: int) -> DataFrame:
    """What had been brought when a month with a snapshot began; several rows of a (person, gift, group) add up."""
    _snapshot(results, OPEN_GROUP_MONTHS, month)
    found = results.read(OPEN_GROUP_VALUES, below=_month(_index(month) + 1))
    if found.isEmpty():
        raise ValueError(f"there is no snapshot of {month} to rebuild from")
    return found


def active_gifts(w: Warehouse, results: Results, from_month: int | None = None, snapshots: int = SNAPSHOTS) -> None:
    """Publish active gifts by group, all months or those from ``from_month`` on, with the snapshots for the next run.

    Snapshots of earlier runs that lie after ``from_month`` and before the run's own are made anew, as they add up.
    """
    before = None if from_month is None else _entering_group_values(results, from_month)
    with one_run(w, "older"), results.publish() as write:
        later = changes_from(w, from_month)
        grouped = settle(grouped_changes(later))
        totalled = settle(state.totals_by_change(grouped))
        unsettle(grouped)
        details = state.latest_change_per_group_month(w, totalled, totalled=True)
        details = details.select("constituent_id", "gift_id", "group_id", "month", F.col("change_annual_amount").cast("decimal(38,4)").alias("change_annual_amount"))
        if from_month is not None:
            details = details.unionByName(before.withColumn("month", F.lit(_month(_index(from_month) - 1))))
        details = settle(details)
        unsettle(totalled)
        rows = state.active_gift_value_by_group(w, details, w.as_of)
        # Its spans are settled, so the facts aren't read again, and the spans aren't once the table is written.
        w.unsettle()
        if from_month is not None:
            rows = rows.filter(F.col("month") >= from_month)
        write.months(rows, RESULTS["active_gift_value_by_group"], from_month)
        unsettle(rows)
        if months := snapshot_months(w, from_month, snapshots):
            first = None
            if from_month is not None:
                first = _month(_index(from_month) + 1)
                kept = results.read(OPEN_GROUP_MONTHS, first, months[0])
                months = [*sorted(r["month"] for r in kept.select("month").collect()), *months]
                details = details.filter(F.col("month") >= from_month)
            write.months(open_group_values(details, months), OPEN_GROUP_VALUES, first)
            stored = details.sparkSession.createDataFrame([(w.as_of, month) for month in months], "as_of date, month int")
            write.months(stored, OPEN_GROUP_MONTHS, first)
