"""Result tables that are published all at once, kept by month, and rebuilt from a month on.

Layout under one folder::

    data/<run>/<table>/month=<yyyymm>/…      what one run wrote of a table; never changed afterwards
    published/<number>.json                  which stretches of months of which runs make up each table

A run writes all its tables aside. Only when the last one is complete is the next publication put in place, by one
rename. Readers take the newest publication, so they see the whole old set or the whole new one, whenever a run dies.
Rebuilding from a month writes the months from it on; the publication goes on pointing at the earlier months of
earlier runs, so nothing is copied, and reading a stretch of months prunes to its folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from givetide.sources.warehouse import shuffles_deleted

MONTH = "month"


class Results:
    """The result tables under ``folder``, which every executor must be able to read and write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, files = self._path("published")
        if not files.exists(path):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(path) if f.getPath().getName().endswith(".json"))

    def publication(self, number: int | None = None) -> tuple[int, dict[str, dict]]:
        """Number and tables of a publication, the newest unless named; (0, {}) before the first."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/published/{number:012d}.json", wholetext=True).first()[0]
        return number, json.loads(text)

    def read(self, table: str, from_month: int | None = None, below: int | None = None, number: int | None = None) -> DataFrame:
        """A table as published, or its months from ``from_month`` on and below ``below``.

        Rows without a month belong to the newest run that wrote the table, and to readings without bounds.
        """
        tables = self.publication(number)[1]
        if table not in tables:
            raise KeyError(f"{table} is not published in {self.folder}")
        schema, parts = tables[table]["schema"], tables[table]["parts"]
        read = []
        for i, part in enumerate(parts):
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{part['path']}")
            if tables[table]["monthly"]:
                upper = min((x for x in (part["below"], below) if x is not None), default=None)
                if upper is not None and from_month is not None and upper <= from_month:
                    continue
                bounded = F.lit(True)
                if from_month is not None:
                    bounded &= F.col(MONTH) >= from_month
                if upper is not None:
                    bounded &= F.col(MONTH) < upper
                if from_month is None and below is None and i == len(parts) - 1:
                    bounded |= F.col(MONTH).isNull()
                rows = rows.filter(bounded)
            read.append(rows)
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    @contextmanager
    def publish(self) -> Iterator[Writer]:
        """All tables written in the block appear together at its end; if it fails, none does."""
        number, tables = self.publication()
        writer = Writer(self, uuid.uuid4().hex, tables)
        try:
            yield writer
            self._put(number, writer.tables)
        except BaseException:
            path, files = self._path(f"data/{writer.run}")
            files.delete(path, True)
            raise

    def _put(self, base: int, tables: dict[str, dict]) -> None:
        """Publish as the successor of ``base``; a run that published since raises an error."""
        claim, files = self._path(f"published/{base + 1:012d}.claim")
        aside, _ = self._path(f"published/.{uuid.uuid4().hex}")
        place, _ = self._path(f"published/{base + 1:012d}.json")
        try:
            files.create(claim, False).close()
        except Exception as error:
            raise RuntimeError(f"another run publishes in {self.folder}; remove {claim} if it died") from error
        try:
            if max(self._numbers(), default=0) != base:
                raise RuntimeError(f"another run has published in {self.folder}")
            out = files.create(aside, False)
            out.write(bytearray(json.dumps(tables, indent=1), "utf-8"))
            out.close()
            if not files.rename(aside, place):
                raise RuntimeError(f"{place} could not be put in place")
        finally:
            files.delete(claim, False)

    def tidy(self, keep: int = 2) -> int:
        """Delete what the last ``keep`` publications don't point at, and return the number of runs whose data went.

        To be called between runs: what a run in progress has written isn't published yet.
        """
        numbers = self._numbers()
        kept = {p["path"].split("/")[1] for n in numbers[-keep:] for t in self.publication(n)[1].values() for p in t["parts"]}
        for n in numbers[:-keep]:
            path, files = self._path(f"published/{n:012d}.json")
            files.delete(path, False)
        path, files = self._path("data")
        old = [f.getPath() for f in files.listStatus(path) if f.getPath().getName() not in kept] if files.exists(path) else []
        for run in old:
            files.delete(run, True)
        return len(old)


class Writer:
    """Writes tables of one run aside; call it with a frame and a table's name, or use ``months`` for a stretch."""

    def __init__(self, results: Results, run: str, tables: dict[str, dict]):
        self.results, self.run = results, run
        self.tables = json.loads(json.dumps(tables))

    def __call__(self, df: DataFrame, table: str) -> None:
        """Replace a table: kept by month if it has that column."""
        self.months(df, table, None)

    def months(self, df: DataFrame, table: str, from_month: int | None) -> None:
        """Replace the months of a table from ``from_month`` on, and its rows without a month; all of it by default.

        A row below ``from_month`` raises an error when it is written.
        """
        monthly = MONTH in df.columns
        if from_month is not None and not monthly:
            raise ValueError(f"{table} has no column {MONTH}")
        path = f"data/{self.run}/{table}"
        if monthly:
            df = df.select(*[c for c in df.columns if c != MONTH], MONTH)
            if from_month is not None:
                late = F.when(F.col(MONTH) < from_month, F.raise_error(F.lit(f"a row of {table} is before {from_month}"))).otherwise(F.col(MONTH))
                df = df.withColumn(MONTH, late.cast(df.schema[MONTH].dataType))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        # Rows of a month lie together, but a month of any size is split over several tasks and files.
        writer = df.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH) if monthly else df.write
        with shuffles_deleted(self.results.spark):
            writer.mode("errorifexists").parquet(f"{self.results.folder}/{path}")
        old = self.tables.get(table)
        if from_month is not None and old and (not old["monthly"] or old["schema"] != schema):
            raise ValueError(f"{table} was published with other columns; rebuild all its months")
        parts = old["parts"] if old and from_month is not None else []
        parts = [{**p, "below": min(p["below"] or from_month, from_month)} for p in parts]
        # Stretches of which no month is left are no longer pointed at.
        parts = [p for p in parts if p["first"] is not None and p["first"] < p["below"]]
        self.tables[table] = {"schema": schema, "monthly": monthly, "parts": [*parts, {"path": path, "first": self._first_month(path), "below": None}]}

    def _first_month(self, path: str) -> int | None:
        place, files = self.results._path(path)
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return min((int(n.split("=")[1]) for n in names if n.startswith(f"{MONTH}=") and n.split("=")[1].isdigit()), default=None)
