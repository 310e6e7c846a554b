import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from givetide.operators import numbering
from givetide.operators.numbering import number_groups, number_rows, placed_in_order
from givetide.sources.roles import LINE_ORDER, warehouse_of

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_numbers_equal_sorting_each_group(spark, partitions):
    rng = random.Random(partitions)
    data = [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, *range(40)]), "x" * rng.randint(0, 3)) for _ in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = number_rows(spark.createDataFrame(data, "g int, v int, s string"), "g", ["v", "s"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r["g"], r["v"], r["s"]) for r in got), key=str) == sorted(data, key=str)
    key = lambda r: (r["v"] is not None, r["v"] or 0, r["s"])
    for g in {r["g"] for r in got}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["sequence"])
        assert [r["sequence"] for r in mine] == list(range(1, len(mine) + 1))
        assert [key(r) for r in mine] == sorted(map(key, mine))


def test_no_rows_and_too_many_rows(spark):
    assert number_rows(spark.range(0).toDF("g"), "g", []).count() == 0
    with pytest.raises(Exception, match="a g has more than 3 rows"):
        number_rows(spark.range(4).selectExpr("1 as g", "id"), "g", ["id"], most=3).collect()


def hot_lines(spark):
    """The lines, a third of them on one order and one day, some of those alike in everything."""
    lines = spark.read.parquet(f"{SMALLEST}/lineitem.parquet")
    hot = F.pmod(F.xxhash64(*lines.columns), F.lit(3)) == 0
    changed = {"l_orderkey": F.lit(17).cast("long"), "l_shipdate": F.lit("1998-01-01").cast("timestamp")}
    lines = lines.select(hot.alias("hot"), *lines.columns)
    return lines.withColumns({c: F.when(F.col("hot"), v).otherwise(F.col(c)) for c, v in changed.items()}).drop("hot")


def test_a_third_of_the_lines_on_one_order_and_day_spreads_evenly(spark):
    lines = hot_lines(spark).unionByName(hot_lines(spark).filter("l_orderkey = 17 and l_linenumber = 1"))
    days = lines.selectExpr("*", "to_date(l_shipdate) as ship_day")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        placed = placed_in_order(days, "l_orderkey", ["ship_day", *LINE_ORDER])
        sizes = sorted(r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 12
        assert sizes[-1] <= 2 * sizes[6]
        numbered = number_rows(days, "l_orderkey", ["ship_day", *LINE_ORDER])
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        hot = numbered.filter("l_orderkey = 17").agg(F.count("*"), F.count_distinct("sequence"), F.max("sequence"), F.count_distinct(F.col("sequence") * 0)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hot[0] > 2000
    assert hot[0] == hot[1] == hot[2]


def test_hot_lines_equal_a_window(spark, tmp_path):
    import duckdb

    hot_lines(spark).write.parquet(f"{tmp_path}/lineitem")
    lines = spark.read.parquet(f"{tmp_path}/lineitem")
    got = number_rows(lines.selectExpr("*", "to_date(l_shipdate) as ship_day"), "l_orderkey", ["ship_day", *LINE_ORDER]).select("l_orderkey", *LINE_ORDER, "sequence").toPandas()
    want = duckdb.sql(
        f"select l_orderkey, {', '.join(LINE_ORDER)}, row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)}) as sequence from '{tmp_path}/lineitem/*.parquet'"
    ).df()
    assert difference(got, want) is None


@pytest.mark.parametrize("gathered", [1_000_000, 60, 0])
def test_numbers_by_window_and_by_ranges_equal_sorting(spark, gathered):
    """Small groups are numbered by a window, crowded ones and a crowded null group over ranges."""
    rng = random.Random(gathered)
    data = [(rng.choice([None, 1, 1, 1, 2, *range(3, 40)]), rng.randint(0, 5), i) for i in range(900)]
    df = spark.createDataFrame(data, "g int, v int, id int")
    got = number_groups(df, "g", ["v", "id"], df.select("g"), gathered=gathered).collect()
    nth = Counter()
    want = []
    for g, v, i in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        nth[g] += 1
        want.append((g, v, i, nth[g]))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="a g has more than 3 rows"):
        number_groups(df, "g", ["id"], df.select("g"), most=3, gathered=gathered).collect()


def test_lines_of_small_orders_need_no_range_partitions(spark, monkeypatch):
    monkeypatch.setattr(numbering, "number_rows", None)
    w = warehouse_of(spark, SMALLEST)
    assert w.gift_change.count() == spark.read.parquet(f"{SMALLEST}/lineitem.parquet").join(
        spark.read.parquet(f"{SMALLEST}/orders.parquet").selectExpr("o_orderkey as l_orderkey"), "l_orderkey", "left_semi").count()
