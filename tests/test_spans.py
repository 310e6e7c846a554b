import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from givetide.functions.months import index_of
from givetide.operators.spans import expand_months, merge_spans, span_totals


def _random_spans(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = 24000 + rng.randrange(30)
        amount = None if rng.random() < 0.2 else Decimal(rng.randrange(-500, 500)) / 4
        # One key holds a third of the rows; one key is NULL.
        key = rng.choice(["hot", "hot", "a", "b", None, "c"])
        rows.append((key, rng.randrange(8), start, start + rng.randrange(-2, 12), amount))
    return rows


def test_totals_equal_the_month_by_month_sum(spark):
    rows = _random_spans(1)
    df = spark.createDataFrame(rows, "k string, who int, start int, stop int, v decimal(19,4)")
    got = {
        (r.k, r.i): (r.total, r.n)
        for r in span_totals(df, ["k"], {"total": "v"}, {"n": F.lit(1)}).withColumn("i", index_of(F.col("month"))).collect()
    }
    want = defaultdict(list)
    for key, _, start, stop, amount in rows:
        for i in range(start, stop):
            want[key, i].append(amount)
    assert got.keys() == want.keys()
    for key, amounts in want.items():
        known = [a for a in amounts if a is not None]
        assert got[key] == (sum(known) if known else None, len(amounts))


def test_merged_spans_count_each_month_once(spark):
    rows = _random_spans(2)
    df = spark.createDataFrame(rows, "k string, who int, start int, stop int, v decimal(19,4)").select("k", "who", "start", "stop")
    merged = merge_spans(df, ["k", "who"])
    months = expand_months(merged)
    assert months.count() == months.distinct().count()
    want = {(k, w, i) for k, w, start, stop, _ in rows for i in range(start, stop)}
    got = {(r.k, r.who, r.i) for r in months.withColumn("i", index_of(F.col("month"))).collect()}
    assert got == want
    gaps = merged.alias("a").join(merged.alias("b"), (F.col("a.k").eqNullSafe(F.col("b.k"))) & (F.col("a.who") == F.col("b.who")))
    assert gaps.filter("a.stop = b.start").count() == 0
