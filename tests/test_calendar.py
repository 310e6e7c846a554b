import datetime as dt

import pytest
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.operators.calendar import calendar, month_spine


def test_month_arithmetic(spark):
    row = (
        spark.createDataFrame([(200112,), (200201,), (200103,), (200104,)], "month int")
        .select(
            F.collect_list(m.index_of(F.col("month"))).alias("i"),
            F.collect_list(m.month_at(m.index_of(F.col("month")) + 1)).alias("next"),
            F.collect_list(m.fiscal_year(F.col("month"))).alias("fy"),
            F.collect_list(m.fiscal_year(F.col("month"), 1)).alias("calendar_fy"),
        )
        .first()
    )
    assert row.i == [24023, 24024, 24014, 24015]
    assert row.next == [200201, 200202, 200104, 200105]
    assert row.fy == [2002, 2002, 2001, 2002]
    assert row.calendar_fy == [2001, 2002, 2001, 2001]


@pytest.mark.parametrize("as_of", [dt.date(2001, 1, 15), dt.date(2001, 4, 1), dt.date(2001, 3, 31)])
def test_offsets_and_flags_follow_as_of(spark, as_of):
    days = calendar(spark, dt.date(2000, 1, 1), dt.date(2002, 12, 31), as_of)
    today = days.filter("is_current_date").collect()
    assert [(r.date, r.months_since, r.days_since) for r in today] == [(as_of, 0, 0)]
    assert days.filter("is_current_month").select("month").distinct().collect()[0].month == as_of.year * 100 + as_of.month
    years = {r.fiscal_year for r in days.filter("is_current_fiscal_year").select("fiscal_year").distinct().collect()}
    assert years == {as_of.year + (as_of.month >= 4)}


def test_spine_has_one_row_per_month_and_days_since_its_end(spark):
    days = calendar(spark, dt.date(2001, 1, 1), dt.date(2001, 12, 31), dt.date(2001, 9, 15))
    spine = month_spine(days)
    assert spine.count() == 12
    assert spine.filter("month = 200108").first().days_since_month_end == 15
    assert spine.filter("month = 200109").first().days_since_month_end == -15
    assert {r.month for r in spine.filter("months_since > 0").collect()} == {200100 + i for i in range(1, 9)}


def test_span_is_checked(spark):
    with pytest.raises(ValueError):
        calendar(spark, dt.date(2001, 1, 2), dt.date(2001, 1, 1), dt.date(2001, 1, 1))
    with pytest.raises(ValueError):
        calendar(spark, dt.date(1, 1, 1), dt.date(9000, 1, 1), dt.date(2001, 1, 1))
