"""Hand-made warehouse tables: rows as dicts, missing columns NULL."""

import datetime as dt
from decimal import Decimal

from givetide.operators.calendar import calendar, month_spine
from givetide.sources.schemas import NEWER_CONSTITUENT, TABLES
from givetide.sources.warehouse import Warehouse

AS_OF = dt.date(2001, 9, 15)
D = dt.date


def _typed(value, kind):
    return Decimal(str(value)) if value is not None and kind.startswith("decimal") else value


def table(spark, role, rows=(), columns=None):
    """Rows of a role under the package's own column names."""
    kinds = {name: kind for name, kind in (columns or TABLES[role][1]).values()}
    unknown = {k for row in rows for k in row} - set(kinds)
    assert not unknown, unknown
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return spark.createDataFrame([tuple(_typed(row.get(n), k) for n, k in kinds.items()) for row in rows], schema)


def stored(spark, role, rows=(), columns=None):
    """The same rows under the warehouse's column names."""
    columns = columns or TABLES[role][1]
    return table(spark, role, rows, columns).toDF(*columns)


def warehouse(spark, newer=(), **roles):
    tables = {role: (lambda r=role: table(spark, r, roles.get(r, ()))) for role in TABLES}
    if newer:
        tables["constituent"] = lambda: table(spark, "constituent", newer, NEWER_CONSTITUENT[1])
    days = lambda: calendar(spark, D(1999, 1, 1), D(2002, 12, 31), AS_OF)
    return Warehouse({**tables, "calendar": days, "months": lambda: month_spine(days())}, AS_OF)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, v) for v in r])
