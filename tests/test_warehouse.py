import datetime as dt

import pytest
from fixture import AS_OF, rows, stored
from pyspark.sql import functions as F

from givetide.operators.calendar import calendar, month_spine
from givetide.plans import active_gifts, dashboard, file_size, outreach
from givetide.sources import warehouse as wh
from givetide.sources.roles import warehouse_of
from givetide.sources.schemas import NEWER_CONSTITUENT, TABLES
from givetide.sources.warehouse import ADVISORY, INITIAL, SCAN, SCAN_BYTES, SHUFFLED, TASK_BYTES, guard

SMALLEST = "/root/testdata/sf0.001"


def stored_dates(spark):
    days = calendar(spark, dt.date(2000, 1, 1), dt.date(2002, 12, 31), AS_OF)
    return days.select(
        F.col("date_key").alias("DateDimID"),
        F.col("date").alias("ActualDate"),
        F.col("month").alias("CalendarYearMonth"),
        F.col("calendar_year").alias("CalendarYear"),
        F.col("month_name").alias("CalendarMonthName"),
        F.col("fiscal_year").alias("FiscalYear"),
    )


def test_tables_are_read_by_their_warehouse_names(spark, tmp_path):
    for role, (name, _) in TABLES.items():
        stored(spark, role).write.parquet(f"{tmp_path}/{name}.parquet")
    stored(spark, "gift_status_date", [dict(gift_system_id=7, status="Held", status_date=dt.date(2001, 1, 2))]).write.mode(
        "overwrite"
    ).parquet(f"{tmp_path}/GiftStatusDate.parquet")
    stored_dates(spark).write.parquet(f"{tmp_path}/DIM_Date.parquet")
    w = wh.open_warehouse(spark, AS_OF, wh.read_parquet_from(spark, str(tmp_path)))
    assert rows(w.gift_status_date) == [(7, "Held", dt.date(2001, 1, 2))]
    for role, (_, columns) in TABLES.items():
        assert getattr(w, role).columns == [name for name, _ in columns.values()]
    built = calendar(spark, dt.date(2000, 1, 1), dt.date(2002, 12, 31), AS_OF)
    assert rows(w.calendar) == rows(built)
    assert rows(w.months) == rows(month_spine(built))
    with pytest.raises(AttributeError):
        w.nothing


def test_only_wanted_columns_reach_the_scan(spark, tmp_path):
    stored(spark, "gift").write.parquet(f"{tmp_path}/FACT_Gift.parquet")
    w = wh.open_warehouse(spark, AS_OF, wh.read_parquet_from(spark, str(tmp_path)))
    plan = w.gift.filter("gift_type_id = 30").select("gift_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<GiftFactID:bigint,GiftTypeDimID:int>" in plan
    assert "EqualTo(GiftTypeDimID,30)" in plan


def test_newer_generation_has_its_own_constituents(spark):
    tables = {"DIM_Constituent": stored(spark, "constituent", [dict(constituent_key=1, key_indicator="O")], NEWER_CONSTITUENT[1])}
    w = wh.open_warehouse(spark, AS_OF, tables.__getitem__, newer=True)
    assert w.constituent.columns[:3] == ["constituent_key", "key_indicator", "organisation_type"]


def test_a_site_may_name_tables_and_columns_its_own_way(spark):
    spark.sql("create database if not exists other_site")
    try:
        mine = stored(spark, "nonfinancial_target", [dict(team="T", month=200101, target_value=3)])
        mine.withColumnRenamed("Team", "Unit").write.mode("overwrite").saveAsTable("other_site.goals")
        names = {"NonFinancialTargets": "spark_catalog.other_site.goals", "NonFinancialTargets.Team": "Unit"}
        w = wh.open_warehouse(spark, AS_OF, newer=True, names=names)
        assert rows(w.nonfinancial_target, "team", "month") == [("T", 200101)]
    finally:
        spark.sql("drop database other_site cascade")


def test_generations_are_not_mixed_and_runs_clean_up(spark):
    tables = {"DIM_Date": stored_dates(spark)}
    w = wh.open_warehouse(spark, AS_OF, tables.__getitem__)
    with pytest.raises(ValueError, match="newer"):
        outreach.run(w)
    folder = None
    with pytest.raises(ZeroDivisionError), wh.one_run(w, "older"):
        folder = wh.run_folder(spark)
        wh.settle(spark.range(3).toDF("x"))
        1 / 0  # noqa: B018
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert wh.run_folder(spark) != folder


def test_today_must_be_a_day_of_the_date_table(spark):
    w = wh.open_warehouse(spark, dt.date(2010, 1, 1), {"DIM_Date": stored_dates(spark)}.__getitem__)
    with pytest.raises(Exception, match="has no day 2010-01-01"):
        w.calendar.collect()


def test_every_status_date_finds_a_month(spark):
    w = warehouse_of(spark, "/root/testdata/sf0.01")
    dated = w.gift_status_date.filter("status_date is not null")
    known = w.calendar.select(F.col("date").alias("status_date"))
    assert dated.count() > 0
    assert dated.join(known, "status_date", "left_anti").count() == 0


def test_lines_without_sequence_are_not_numbered(spark):
    w = warehouse_of(spark, SMALLEST)
    assert w.regular_gift.count() > 0
    assert w.cash_given.count() > 0
    assert not w._settled
    assert rows(w.cash_given) == rows(w.cash_gift.drop("gift_id"))
    assert rows(w.regular_gift, "gift_id") == rows(w.gift.filter("gift_type_id = 30"), "gift_id")
    assert list(w._settled) == ["lines"]
    # A copy shares what was settled, but not the parts of a role that it replaces.
    copy = w.replace(gift=w.gift.limit(0))
    assert copy._settled is w._settled
    assert copy.regular_gift.count() == 0


def test_result_tables_are_replaced(spark):
    from givetide.sources.schemas import RESULTS

    name = RESULTS["file_size_actuals"]
    spark.sql(f"drop table if exists {name}")
    try:
        for n in (3, 2):
            wh.replace_table(spark.range(n).toDF("people"), "file_size_actuals")
            assert spark.table(name).count() == n
    finally:
        spark.sql(f"drop table if exists {name}")


def test_settled_tables_live_in_the_shared_folder(spark):
    settled = wh.settle(spark.range(5).toDF("x"))
    assert settled.count() == 5
    assert wh.run_folder(spark) in settled.inputFiles()[0]


def test_runs_write_what_the_queries_return(spark):
    from checks.compare import difference
    from checks.queries import REGISTERED, STORED_AT, plain

    results = {}

    def write(df, name):
        results[name] = plain(df).toPandas()

    w = warehouse_of(spark, SMALLEST)
    file_size.run(w, write)
    active_gifts.run(w, write)
    dashboard.run(w, STORED_AT, write)
    outreach.run(w, write)
    assert sorted(results) == sorted(wh.RESULTS.values())
    for query, name in {**wh.RESULTS, "event_signups_filled": wh.RESULTS["event_signups"], "pack_sends_filled": wh.RESULTS["pack_sends"]}.items():
        if query not in ("event_signups", "pack_sends"):
            assert difference(results[name], REGISTERED[query](spark, SMALLEST).toPandas()) is None, query


def test_a_tasks_share_of_a_shuffle_is_bounded_at_any_size(spark):
    """Adaptive execution merges up to 64 MB by default, and a fixed number of partitions grows with the input."""
    kept = {k: spark.conf.get(k, None) for k in (ADVISORY, INITIAL)}
    try:
        spark.conf.set(ADVISORY, "64MB")
        guard(spark, 10 * TASK_BYTES)
        assert int(spark.conf.get(ADVISORY)) == TASK_BYTES
        assert int(spark.conf.get(INITIAL)) == 10 * SHUFFLED
        spark.conf.set(ADVISORY, "8m")
        guard(spark, 1)
        assert spark.conf.get(ADVISORY) == "8m"
        assert spark.conf.get(INITIAL, None) is None
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_tasks_share_of_files_is_bounded_at_any_size(spark):
    """Spark reads up to 128 MB in a task by default, and what that task sorts before a shuffle grows with it."""
    before = spark.conf.get(SCAN)
    try:
        spark.conf.set(SCAN, "128MB")
        guard(spark)
        assert int(spark.conf.get(SCAN)) == SCAN_BYTES
        spark.conf.set(SCAN, "1m")
        guard(spark)
        assert spark.conf.get(SCAN) == "1m"
    finally:
        spark.conf.set(SCAN, before)
