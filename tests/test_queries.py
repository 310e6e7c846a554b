"""Every registered query against its DuckDB statement, evenly spread and skewed."""

import shutil
from pathlib import Path

import duckdb
import pytest

from checks.compare import connect, difference
from checks.oracle import statements
from checks.queries import REGISTERED

SMALLEST = "/root/testdata/sf0.001"
SKEWED = [
    "rg_history",
    "latest_state_per_month",
    "carry_forward_amounts",
    "retention_long",
    "mark_deceased",
    "crossed_giving",
    "active_gift_value_by_group",
    "cash_gift_facts",
    "monthly_metrics",
]


def test_every_query_has_a_statement():
    assert set(statements()) == set(REGISTERED)


def test_a_changed_value_is_noticed():
    a = duckdb.sql("select 1 as k, 2.5 as v union all select 2, null").df()
    assert difference(a, a.copy()) is None
    assert difference(a, a.assign(v=[2.5, 0.0]))
    assert difference(a, a.iloc[:1])
    assert difference(a, a.rename(columns={"v": "w"}))


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query_equals_its_statement(spark, name):
    got = REGISTERED[name](spark, SMALLEST).toPandas()
    assert len(got) > 0
    assert difference(got, connect(SMALLEST).execute(statements()[name]).df()) is None


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The smallest tables with a third of the lines on one order and of the orders on one customer."""
    folder = tmp_path_factory.mktemp("skewed")
    for path in Path(SMALLEST).glob("*.parquet"):
        if path.stem not in ("lineitem", "orders"):
            shutil.copy(path, folder)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_custkey")):
        duckdb.sql(
            f"""copy (select * replace (case when hash({key}, rowid) % 3 = 0 then 17 else {key} end as {key})
            from (select *, row_number() over () as rowid from '{SMALLEST}/{name}.parquet')) to '{folder}/{name}.parquet'"""
        )
    return str(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_query_equals_its_statement(spark, skewed, name):
    got = REGISTERED[name](spark, skewed).toPandas()
    assert difference(got, connect(skewed).execute(statements()[name]).df()) is None


@pytest.mark.parametrize("name", ["carry_forward_amounts", "retention_long", "file_size_actuals", "active_gift_value_by_group", "giver_status"])
def test_no_month_range_join_is_a_nested_loop(spark, name):
    plan = REGISTERED[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
