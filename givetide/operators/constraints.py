"""Constraint pass: keys that should be unique, columns that should be filled, references that should be met.

The operators take some properties of the warehouse for granted: a change is identified by its gift and sequence, and a
row of a dimension by its key. Names that are not unique are allowed but multiply rows. The pass measures all of this
before facts are joined. Every rule aggregates by its key first, so a key that holds a third of the rows is one row
before it meets anything, and the report has one row per rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from givetide.functions import text
from givetide.sources.warehouse import Warehouse

UNIQUE, FILLED, REFERS = "unique", "filled", "refers"


@dataclass(frozen=True)
class Rule:
    """What should hold for some columns of a role; ``to`` is the role and column that a reference must be found in."""

    kind: str
    role: str
    columns: tuple[str, ...]
    to: tuple[str, str] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind} {self.role}({', '.join(self.columns)})" + (f" in {self.to[0]}({self.to[1]})" if self.to else "")


def unique(role: str, *columns: str) -> Rule:
    """No two rows are equal in all of the columns; rows with a null among them are left to ``filled``."""
    return Rule(UNIQUE, role, columns)


def filled(role: str, column: str) -> Rule:
    """No row has a null in the column."""
    return Rule(FILLED, role, (column,))


def refers(role: str, column: str, to: str, key: str | None = None) -> Rule:
    """Each value is found in the other role; nulls refer to nothing and are left to ``filled``."""
    return Rule(REFERS, role, (column,), (to, key or column))


#: What the operators need to give right results.
NEEDED = [
    unique("gift", "gift_id"),
    unique("gift_change", "gift_id", "sequence"),
    filled("gift_change", "gift_id"),
    filled("gift_change", "sequence"),
    filled("gift_change", "change_date_key"),
    unique("appeal", "appeal_id"),
    unique("package", "package_id"),
    unique("campaign", "campaign_id"),
    unique("calendar", "date_key"),
    refers("gift_change", "change_date_key", "calendar", "date_key"),
]
#: Names by which facts are joined; each one that repeats multiplies rows.
NAMES = [unique("appeal", "appeal_identifier"), unique("package", "package_identifier"), unique("package", "package_description")]


def _key(df: DataFrame, column: str) -> Column:
    """A column as joins compare it: text without regard to case and trailing blanks."""
    return text.fold(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def _counts(w: Warehouse, role: str, columns: tuple[str, ...]) -> DataFrame:
    df = getattr(w, role)
    keys = [_key(df, c).alias(f"key{i}") for i, c in enumerate(columns)]
    return df.select(*keys).dropna().groupBy(*[f"key{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _report(rule: Rule, failing: Column) -> list[Column]:
    n = F.when(failing, F.col("n"))
    return [
        F.lit(rule.name).alias("rule"),
        _total(n).alias("failing_rows"),
        F.count(n).alias("failing_keys"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("largest"),
        _total(F.col("n") * F.col("n")).alias("rows_joined"),
    ]


def _one(w: Warehouse, rule: Rule) -> DataFrame:
    counts = _counts(w, rule.role, rule.columns)
    if rule.kind == UNIQUE:
        return counts.agg(*_report(rule, F.col("n") > 1)[1:]).select(F.lit(rule.name).alias("rule"), "failing_rows", "failing_keys", "largest", "rows_joined")
    other = getattr(w, rule.to[0])
    known = other.select(_key(other, rule.to[1]).alias("key0")).dropna().distinct().withColumn("known", F.lit(True))
    found = counts.join(known, "key0", "left")
    failing = _report(rule, F.col("known").isNull())[1:4]
    return found.agg(*failing).select(F.lit(rule.name).alias("rule"), "failing_rows", "failing_keys", "largest", F.lit(None).cast("long").alias("rows_joined"))


def _filled(w: Warehouse, role: str, rules: list[Rule]) -> DataFrame:
    """One scan for all columns of a role."""
    df = getattr(w, role)
    nulls = df.agg(*[F.count_if(F.col(r.columns[0]).isNull()).alias(f"n{i}") for i, r in enumerate(rules)])
    rows = F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("failing_rows")) for i, r in enumerate(rules)]))
    none = F.lit(None).cast("long")
    return nulls.select(rows).select("rule", "failing_rows", none.alias("failing_keys"), none.alias("largest"), none.alias("rows_joined"))


def constraint_report(w: Warehouse, rules: Iterable[Rule] = (*NEEDED, *NAMES)) -> DataFrame:
    """(rule, failing_rows, failing_keys, largest, rows_joined), one row for each different rule, also where all is well.

    ``largest`` is the number of rows of the key that fails most often. ``rows_joined`` is, for ``unique``, how many
    rows a join of the table with itself on the key has: with 1,000 appeals of one identifier a million. Columns that a
    kind of rule has no use for are null. Empty tables break no rule; without rules there are no rows.
    """
    rules = list(dict.fromkeys(rules))
    by_role: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.kind == FILLED:
            by_role.setdefault(rule.role, []).append(rule)
    parts = [_filled(w, role, own) for role, own in by_role.items()] + [_one(w, r) for r in rules if r.kind != FILLED]
    if not parts:
        spark = w.calendar.sparkSession
        return spark.createDataFrame([], "rule string, failing_rows long, failing_keys long, largest long, rows_joined long")
    return reduce(DataFrame.unionByName, parts)


def require(w: Warehouse, rules: Iterable[Rule] = tuple(NEEDED), most: Mapping[Rule, int] | None = None) -> list:
    """Raise an error that names every rule in ``rules`` that fails, and return the report's rows otherwise.

    ``most`` watches fan-out: for a ``unique`` rule, how many rows of a key are allowed. Rules given there need not be
    in ``rules``, and are not otherwise required.
    """
    most = dict(most or {})
    if wrong := [r.name for r in most if r.kind != UNIQUE]:
        raise ValueError(f"fan-out is watched on unique rules only: {', '.join(wrong)}")
    rules = list(dict.fromkeys([*rules, *most]))
    bound = {r.name: most.get(r, 1) for r in rules}
    found = constraint_report(w, rules).collect()  # one row for each rule
    failed = [r for r in found if r.failing_rows and (r.largest is None or not r.rule.startswith(UNIQUE) or r.largest > bound[r.rule])]
    if failed:
        raise ValueError("; ".join(f"{r.rule}: {r.failing_rows} rows" + (f", {r.largest} of one key" if r.largest else "") for r in failed))
    return found
