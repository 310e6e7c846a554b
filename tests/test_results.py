"""Results published all at once, kept by month, and rebuilt from a month on."""

import datetime as dt

import pytest
from fixture import AS_OF, rows, stored
from pyspark.sql import functions as F

from checks.compare import difference
from checks.queries import plain
from givetide.plans import rebuild
from givetide.sources import warehouse as wh
from givetide.sources.results import Results
from givetide.sources.roles import warehouse_of
from givetide.sources.schemas import RESULTS

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture
def results(spark, tmp_path):
    return Results(spark, str(tmp_path / "results"))


def monthly(spark, *pairs):
    return spark.createDataFrame(list(pairs), "month int, v string")


def failing(spark):
    return spark.range(5).selectExpr("if(id < 4, id, raise_error('killed')) as v", "200101 as month")


def test_readers_see_the_whole_old_set_or_the_whole_new_one(spark, results):
    with results.publish() as write:
        write(monthly(spark, (200101, "old")), "a")
        write(spark.range(3).toDF("x"), "b")
    with pytest.raises(Exception, match="killed"), results.publish() as write:
        write(monthly(spark, (200101, "new")), "a")
        assert rows(results.read("a"), "v") == [("old",)]
        write(failing(spark), "b")
    assert results.publication()[0] == 1
    assert rows(results.read("a")) == [("old", 200101)]
    assert results.read("b").count() == 3
    # Nothing of the run that failed is left.
    assert results.tidy(1) == 0
    with results.publish() as write:
        write(monthly(spark, (200101, "new")), "a")
    # A table that a run doesn't write stays as it was.
    assert (rows(results.read("a"), "v"), results.read("b").count()) == ([("new",)], 3)
    assert rows(results.read("a", number=1), "v") == [("old",)]


def test_a_run_that_dies_while_publishing_changes_nothing(spark, results, monkeypatch):
    with results.publish() as write:
        write(monthly(spark, (200101, "old")), "a")
    monkeypatch.setattr("givetide.sources.results.json.dumps", lambda *a, **k: "{}" if not k else 1 / 0)
    with pytest.raises(ZeroDivisionError), results.publish() as write:
        write(monthly(spark, (200101, "new")), "a")
    monkeypatch.undo()
    assert rows(results.read("a"), "v") == [("old",)]


def test_of_two_runs_at_once_the_second_raises_an_error(spark, results):
    with pytest.raises(RuntimeError, match="another run"), results.publish() as one:
        one(monthly(spark, (200101, "one")), "a")
        with results.publish() as two:
            two(monthly(spark, (200101, "two")), "a")
    assert rows(results.read("a"), "v") == [("two",)]


def test_months_are_replaced_from_one_on(spark, results):
    with results.publish() as write:
        write(monthly(spark, (200101, "a"), (200102, "b"), (200103, "c"), (None, "x")), "t")
    with results.publish() as write:
        write.months(monthly(spark, (200102, "B"), (200104, "D"), (None, "y")), "t", 200102)
    with results.publish() as write:
        write.months(monthly(spark, (200104, "E")), "t", 200104)
    assert rows(results.read("t"), "month", "v") == [(200101, "a"), (200102, "B"), (200104, "E")]
    assert rows(results.read("t", number=2), "month", "v") == [(None, "y"), (200101, "a"), (200102, "B"), (200104, "D")]
    assert rows(results.read("t", 200102, 200104), "v") == [("B",)]
    assert rows(results.read("t", below=200102), "v") == [("a",)]
    # An earlier start takes the place of all later stretches.
    with results.publish() as write:
        write.months(monthly(spark, (200101, "z")), "t", 200101)
    assert rows(results.read("t")) == [("z", 200101)]
    assert results.tidy(1) == 3
    assert rows(results.read("t")) == [("z", 200101)]


def test_months_before_the_start_and_other_columns_raise_errors(spark, results):
    with results.publish() as write:
        write(monthly(spark, (200101, "a")), "t")
    with pytest.raises(Exception, match="a row of t is before 200102"), results.publish() as write:
        write.months(monthly(spark, (200101, "b")), "t", 200102)
    with pytest.raises(ValueError, match="other columns"), results.publish() as write:
        write.months(monthly(spark, (200102, "b")).withColumnRenamed("v", "w"), "t", 200102)
    with pytest.raises(ValueError, match="has no column month"), results.publish() as write:
        write.months(spark.range(1), "t", 200102)
    with pytest.raises(KeyError):
        results.read("unknown")


def test_reading_a_stretch_prunes_to_its_folders(spark, results):
    with results.publish() as write:
        write(monthly(spark, *[(200100 + i, "a") for i in range(1, 13)]), "t")
    plan = results.read("t", 200103, 200105)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert len(results.read("t", 200103, 200105).filter("v = 'a'").collect()) == 2


def test_catalog_tables_are_exchanged_together(spark):
    names = [RESULTS[n] for n in ("file_size_actuals", "crossed_giving")]
    w = warehouse_of(spark, SMALLEST)
    try:
        with wh.one_run(w, "older"):
            for n in ("file_size_actuals", "crossed_giving"):
                wh.replace_table(spark.range(2).toDF("old"), n)
            assert not any(map(spark.catalog.tableExists, names))
        with pytest.raises(Exception, match="killed"), wh.one_run(w, "older"):
            wh.replace_table(spark.range(1).toDF("new"), "file_size_actuals")
            wh.replace_table(failing(spark), "crossed_giving")
        assert [spark.table(n).columns for n in names] == [["old"], ["old"]]
        with wh.one_run(w, "older"):
            for n in ("file_size_actuals", "crossed_giving"):
                wh.replace_table(spark.range(1).toDF("new"), n)
        assert [spark.table(n).columns for n in names] == [["new"], ["new"]]
        assert not [t.name for t in spark.catalog.listTables() if "__" in t.name]
    finally:
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_an_exchange_that_fails_is_undone(spark):
    spark.range(2).toDF("old").write.saveAsTable("exchanged")
    spark.range(1).toDF("new").write.saveAsTable("exchanged__aside")
    try:
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
            wh.exchange_tables(spark, {"exchanged": "exchanged__aside", "other": "missing__aside"})
        assert spark.table("exchanged").columns == ["old"]
    finally:
        for t in ("exchanged", "exchanged__aside"):
            spark.sql(f"drop table if exists {t}")


def test_later_changes_and_cash_are_asked_of_the_scan(spark, tmp_path):
    for role in ("gift_change", "cash_gift"):
        stored(spark, role).write.parquet(f"{tmp_path}/{wh.TABLES[role][0]}.parquet")
    w = wh.open_warehouse(spark, AS_OF, wh.read_parquet_from(spark, str(tmp_path)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(" in plan(rebuild.changes_from(w, 200102).gift_change).split("PushedFilters")[1]
    assert "20010200" in plan(rebuild.changes_from(w, 200102).gift_change)
    assert "1999-03-01" in plan(rebuild.cash_from(w, 200102).cash_gift).split("PushedFilters")[1]


def test_a_rebuild_needs_a_snapshot(spark, results):
    w = warehouse_of(spark, SMALLEST)
    with pytest.raises(KeyError):
        rebuild.file_size(w, results, 200105)
    with results.publish() as write:
        write(spark.createDataFrame([], "constituent_id long, gift_id long, month int"), rebuild.OPEN_AMOUNTS)
    with pytest.raises(ValueError, match="no snapshot of 200105"):
        rebuild.file_size(w, results, 200105)


@pytest.mark.parametrize("run, tables", [(rebuild.file_size, rebuild.FILE_SIZE), (rebuild.active_gifts, ["active_gift_value_by_group"])])
def test_single_months_merged_equal_a_full_run(spark, tmp_path, run, tables):
    merged, full = Results(spark, f"{tmp_path}/merged"), Results(spark, f"{tmp_path}/full")
    run(warehouse_of(spark, SMALLEST, dt.date(2001, 5, 3)), merged, snapshots=1)
    for month in (6, 7, 8, 9):
        run(warehouse_of(spark, SMALLEST, dt.date(2001, month, 15)), merged, from_month=200100 + month - 1, snapshots=1)
    run(warehouse_of(spark, SMALLEST, dt.date(2001, 9, 15)), full)
    for table in tables:
        got, want = (plain(r.read(RESULTS[table])).toPandas() for r in (merged, full))
        assert len(want) > 100
        assert difference(got, want) is None
    assert merged.publication()[0] == 5


def test_a_change_is_stored_once_however_many_months_have_a_snapshot(spark):
    data = [(1, 1, 50, 200011, 5), (1, 1, 50, 200012, 7), (1, 1, 50, 200102, 1), (2, 2, None, 200102, None), (1, 1, 50, 200106, 9)]
    details = spark.createDataFrame(data, "constituent_id long, gift_id long, group_id int, month int, change_annual_amount int")
    months = [200101, 200102, 200103, 200104, 200105, 200106]
    stored = rebuild.open_group_values(details, months).withColumn("change_annual_amount", F.col("change_annual_amount").cast("int"))
    assert rows(stored, *details.columns) == sorted([(1, 1, 50, 200101, 12), (1, 1, 50, 200103, 1), (2, 2, None, 200103, None)])


def test_a_run_may_start_at_any_month_that_has_a_snapshot(spark, tmp_path):
    """Also where a run from an earlier month came in between."""
    at = lambda month: warehouse_of(spark, SMALLEST, dt.date(2001, month, 15))
    run, table = rebuild.active_gifts, RESULTS["active_gift_value_by_group"]
    full, again = Results(spark, f"{tmp_path}/full"), Results(spark, f"{tmp_path}/again")
    run(at(9), full)
    run(at(6), again, snapshots=80)
    run(at(9), again, from_month=200009, snapshots=1)
    run(at(9), again, from_month=200102, snapshots=1)
    run(at(9), again, from_month=200106, snapshots=1)
    assert difference(plain(again.read(table)).toPandas(), plain(full.read(table)).toPandas()) is None
    stored = again.read(rebuild.OPEN_GROUP_MONTHS).select("month").toPandas()["month"]
    assert sorted(stored) == [*sorted(m for m in range(199411, 200107) if 1 <= m % 100 <= 12), 200109]
    with pytest.raises(ValueError, match="no snapshot of 200107"):
        run(at(9), again, from_month=200107)


def test_the_shuffle_files_of_a_published_table_go_when_it_is_written(spark, results):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    with results.publish() as write:
        write(spark.range(1000).selectExpr("cast(200101 + id % 3 as int) as month", "id").groupBy("month").count(), "a")
    assert files() <= before


def test_what_no_later_step_reads_is_deleted(spark):
    kept, done = wh.settle(spark.range(3)), wh.settle(spark.range(5))
    wh.unsettle(done)
    assert kept.count() == 3
    with pytest.raises(Exception):
        done.collect()
