"""Run every registered query on Spark and its SQL on DuckDB, and compare the results.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.oracle import statements
from checks.queries import REGISTERED


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iub":
            df[c] = df[c].astype("float64")
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind != "f":
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, duck_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(duck_rows.columns):
        return f"columns differ: {sorted(set(spark_rows.columns) ^ set(duck_rows.columns))}"
    if len(spark_rows) != len(duck_rows):
        return f"rows differ: {len(spark_rows)} and {len(duck_rows)}"
    a, b = normal(spark_rows), normal(duck_rows)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values differ in {c}: {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return None


def main(directory: str, names: list[str]) -> int:
    from checks.session import local_session
    from givetide.sources.warehouse import release

    spark, connection, sql = local_session(), connect(directory), statements()
    bad = 0
    for name in names or REGISTERED:
        started = time.time()
        got = REGISTERED[name](spark, directory).toPandas()
        took = time.time() - started
        started = time.time()
        want = connection.execute(sql[name]).df()
        problem = difference(got, want)
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {len(got):8d} rows  spark {took:6.2f}s  duckdb {time.time() - started:6.2f}s  {problem or ''}"[:900], flush=True)
    release(spark)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
