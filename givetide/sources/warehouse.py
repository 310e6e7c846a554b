"""Open a warehouse and write results back to it."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.operators.calendar import month_spine
from givetide.sources.schemas import NEWER_CONSTITUENT, RESULTS, TABLES

FOLDER = "spark.givetide.folder"
RUN = "spark.givetide.run"
#: Whether Spark deletes the shuffle files of a query when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Roles that a source may keep apart, and what they are part of.
PART_OF = {"regular_gift": "gift", "cash_given": "cash_gift"}


class Warehouse:
    """Tables by role, each read on first use: ``w.gift``, ``w.calendar``, ``w.months`` …"""

    def __init__(self, tables: dict[str, Callable[[], DataFrame]], as_of: dt.date, names: Mapping[str, str] | None = None, generation: str | None = None):
        self._tables = dict(tables)
        self.names = dict(names or {})
        self.generation = generation
        self._open: dict[str, DataFrame] = {}
        self._derived: dict[str, DataFrame] = {}
        #: What the tables themselves settled, common to all copies made by ``replace``.
        self._settled: dict[str, DataFrame] = {}
        self.as_of = as_of

    @property
    def regular_gift(self) -> DataFrame:
        """The regular gifts; a source that keeps them apart needn't read the others."""
        return self._table("regular_gift") if "regular_gift" in self._tables else self.gift.filter("gift_type_id = 30")

    @property
    def cash_given(self) -> DataFrame:
        """Cash without the ids of its gifts; a source that has to make these up needn't do so here."""
        return self._table("cash_given") if "cash_given" in self._tables else self.cash_gift.drop("gift_id")

    def __getattr__(self, role: str) -> DataFrame:
        if role.startswith("_") or role not in self._tables:
            raise AttributeError(role)
        return self._table(role)

    def _table(self, role: str) -> DataFrame:
        if role not in self._open:
            self._open[role] = self._tables[role]()
        return self._open[role]

    def dimension(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived dimension, settled once per warehouse.

        Joined dimensions have no usable size estimate. Once written, their real size is
        known, so Spark broadcasts them below its threshold and sort-merges beyond it,
        instead of shuffling a fact on a key of few values.
        """
        if name not in self._derived:
            self._derived[name] = settle(build())
        return self._derived[name]

    def settled(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What several tables of a source are read from, built once for this warehouse and its copies."""
        if name not in self._settled:
            self._settled[name] = build()
        return self._settled[name]

    def replace(self, **tables: DataFrame) -> Warehouse:
        """The same warehouse with some roles read from the given frames."""
        kept = {role: read for role, read in self._tables.items() if PART_OF.get(role) not in tables}
        copy = Warehouse({**kept, **{role: (lambda df=df: df) for role, df in tables.items()}}, self.as_of, self.names, self.generation)
        copy._settled = self._settled
        return copy

    def unsettle(self) -> None:
        """Delete what the tables settled, once nothing reads it any more; what is asked for later is built anew."""
        for df in self._settled.values():
            unsettle(df)
        self.forget()

    def forget(self) -> None:
        """Build everything that was settled anew when it is next asked for."""
        self._derived.clear()
        if self._settled:
            self._settled.clear()
            self._open.clear()


def project(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Read the listed columns only, renamed and typed."""
    return df.select(*[F.col(f"`{source}`").cast(kind).alias(name) for source, (name, kind) in columns.items()])


def dates_of(table: DataFrame, as_of: dt.date) -> DataFrame:
    """A stored date table, with its offsets and flags counted from ``as_of``."""
    day = F.to_date("ActualDate")
    month = F.col("CalendarYearMonth").cast("int")
    days = table.select(
        F.col("DateDimID").cast("int").alias("date_key"),
        day.alias("date"),
        month.alias("month"),
        F.col("CalendarYear").cast("int").alias("calendar_year"),
        F.col("CalendarMonthName").alias("month_name"),
        F.col("FiscalYear").cast("int").alias("fiscal_year"),
        (F.lit(m.as_of_index(as_of)) - m.index_of(month)).cast("int").alias("months_since"),
        F.datediff(F.lit(as_of), day).alias("days_since"),
    )
    current_year = days.filter("days_since = 0").agg(F.max("fiscal_year")).select(F.expr(f"coalesce(`max(fiscal_year)`, raise_error('the date table has no day {as_of}'))")).scalar()
    return days.select(
        "*",
        (F.col("days_since") == 0).alias("is_current_date"),
        (F.col("months_since") == 0).alias("is_current_month"),
        (F.col("fiscal_year") == current_year).alias("is_current_fiscal_year"),
    )


def open_warehouse(
    spark: SparkSession,
    as_of: dt.date,
    read: Callable[[str], DataFrame] | None = None,
    newer: bool = False,
    names: Mapping[str, str] | None = None,
    plain_unions: bool = True,
) -> Warehouse:
    """Roles over named tables.

    ``names`` maps the table names of ``TABLES`` and ``RESULTS`` to a site's own, which may be qualified with
    another database, and ``Table.Column`` to the site's column. ``plain_unions`` applies ``guard`` to the session.

    ``read`` turns a table name into a DataFrame; by default the session catalog does,
    and a name may be qualified with another database. ``newer`` selects the generation
    keyed by surrogate keys, needed for pack requests and faith groups.
    """
    if plain_unions:
        guard(spark)
    names = names or {}
    read_named, read_default = (lambda table: read_default(names.get(table, table))), read or spark.table
    roles = {**TABLES, **({"constituent": NEWER_CONSTITUENT} if newer else {})}

    def own(table: str, columns: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
        return {names.get(f"{table}.{column}", column): to for column, to in columns.items()}

    tables = {role: (lambda t=table, c=columns: project(read_named(t), own(t, c))) for role, (table, columns) in roles.items()}

    def days() -> DataFrame:
        table = read_named("DIM_Date")
        table = table.withColumnsRenamed({to: column.split(".")[1] for column, to in names.items() if column.startswith("DIM_Date.")})
        return dates_of(table.withColumnRenamed("DateSK", "DateDimID") if newer else table, as_of)

    tables["calendar"] = days
    tables["months"] = lambda: month_spine(days())
    return Warehouse(tables, as_of, names, "newer" if newer else "older")


def read_parquet_from(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    """Reader for a directory with one parquet table per warehouse table."""
    return lambda table: spark.read.parquet(f"{directory}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: the session's checkpoint directory.

    A session that was started without one may name the folder in ``FOLDER``; one of the two must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of the run in progress, or of the application outside of runs."""
    run = spark.conf.get(RUN, None)
    return f"{shared_folder(spark)}/givetide-{spark.sparkContext.applicationId}" + (f"/run-{run}" if run else "")


@contextmanager
def one_run(w: Warehouse, generation: str) -> Iterator[None]:
    """A run over tables of one generation, with a folder of its own that is deleted at its end, however it ends.

    Catalog tables that the run replaces are written aside and exchanged together when the run is through; a run that
    fails leaves all of them as they were.
    """
    if w.generation not in (None, generation):
        raise ValueError(f"this run reads the {generation} tables, but the {w.generation} ones are open")
    spark = w.calendar.sparkSession
    before = spark.conf.get(RUN, None)
    w.forget()
    spark.conf.set(RUN, run := uuid.uuid4().hex)
    _aside[run] = {}
    try:
        yield
        exchange_tables(spark, _aside[run])
    finally:
        for aside in _aside.pop(run).values():
            spark.sql(f"drop table if exists {aside}")
        release(spark)
        w.forget()
        spark.conf.unset(RUN)
        if before:
            spark.conf.set(RUN, before)


#: Tables that the runs in progress have written aside, by their names.
_aside: dict[str, dict[str, str]] = {}


def _beside(name: str, suffix: str) -> str:
    """A table name next to another one, which may be qualified and quoted."""
    return f"{name[:-1]}__{suffix}`" if name.endswith("`") else f"{name}__{suffix}"


def exchange_tables(spark: SparkSession, aside: Mapping[str, str]) -> None:
    """Put each written table in the place of its name, by renaming only; undone if one of them can't be."""
    former = {name: _beside(name, f"before_{uuid.uuid4().hex[:8]}") for name in aside if spark.catalog.tableExists(name)}
    done: list[tuple[str, str]] = []
    try:
        for name, written in aside.items():
            steps = [(name, former[name])] if name in former else []
            for old, new in [*steps, (written, name)]:
                spark.sql(f"alter table {old} rename to {new}")
                done.append((old, new))
    except BaseException:
        for old, new in reversed(done):
            spark.sql(f"alter table {new} rename to {old}")
        raise
    for name in former.values():
        spark.sql(f"drop table {name}")


def release(spark: SparkSession) -> None:
    """Delete what this application settled; call it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a task's share of a shuffle. Sorts and windows hold it decompressed, several at a time, in some 20 to 30 times that.
TASK_BYTES = 16 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Stored bytes that a task reads. What it sorts or sums before a shuffle takes some 15 to 40 times that.
SCAN_BYTES = 8 << 20
SCAN = "spark.sql.files.maxPartitionBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Shuffled bytes for each stored byte of the facts, about: their widest shuffle, which is less tightly packed than parquet.
SHUFFLED = 3


def guard(spark: SparkSession, stored: int = 0) -> None:
    """Keep unions from reusing their inputs' partitioning, and a task's share of files and shuffles small, whatever the input's size.

    In Spark 4.1 adaptive execution may coalesce the inputs differently, and the union
    then fails with "Can't zip RDDs with unequal numbers of partitions".

    A task that reads files sorts or sums all of them before it writes a shuffle, so it gets ``SCAN_BYTES`` at most, where
    Spark's share grows with the table up to 128 MB. Adaptive execution merges partitions up to ``TASK_BYTES``, or the session's own size if that is less. It can't split
    them, so facts of ``stored`` bytes begin with as many as they need where the session has fewer.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if _bytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    if _bytes(spark.conf.get(SCAN)) > SCAN_BYTES:
        spark.conf.set(SCAN, str(SCAN_BYTES))
    needed = -(-stored * SHUFFLED // TASK_BYTES)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(needed))
    elif stored:
        spark.conf.unset(INITIAL)


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings spell it."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bytes_at(spark: SparkSession, path: str) -> int:
    """Stored bytes of a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every query in the block go as soon as it ends."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several later steps read the same expensive result. The written table cuts
    the lineage, survives lost executors, and keeps column pruning for its readers. Nothing reads the shuffles behind it
    again, so their files go as soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(settled: DataFrame) -> None:
    """Delete a settled result that nothing reads any more."""
    spark = settled.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in settled.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_table(df: DataFrame, result: str, write: Callable[[DataFrame, str], None] | None = None, names: Mapping[str, str] | None = None) -> None:
    """Full reload of a result table: created when missing, replaced when present.

    The table is written aside and takes its place when the run that writes it is through; outside of runs, at once.
    """
    name = (names or {}).get(RESULTS[result], RESULTS[result])
    if write is not None:
        write(df, name)
        return
    spark = df.sparkSession
    run = spark.conf.get(RUN, None)
    aside = {} if run is None else _aside[run]
    written = _beside(name, f"aside_{run or uuid.uuid4().hex}")
    try:
        df.write.saveAsTable(written)
    except BaseException:
        spark.sql(f"drop table if exists {written}")
        raise
    aside[name] = written
    if run is None:
        exchange_tables(spark, aside)
