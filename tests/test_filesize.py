from decimal import Decimal

from fixture import AS_OF, D, rows, warehouse
from pyspark.sql import functions as F

from givetide.operators import filesize as fs

NOW = 2001 * 12 + 8


def at(month):
    return month // 100 * 12 + month % 100 - 1


def person(i, **more):
    return dict(constituent_key=i, constituent_id=i, key_indicator="I", is_deceased="No") | more


def cash(i, day, amount, counted="Yes", gift_id=0):
    return dict(gift_id=gift_id, constituent_id=i, gift_date=day, gift_amount=amount, is_counted=counted)


def spans(spark, data):
    data = [(*r[:5], Decimal(r[5])) for r in data]
    return spark.createDataFrame(
        data, "constituent_id bigint, gift_id bigint, payment_type string, start int, stop int, annual_amount decimal(19,4)"
    )


def lives(spark, data):
    return spark.createDataFrame(data, "gift_id bigint, setup_month int, cancel_month int, final_active_month int")


def test_cash_counts_for_24_months_and_complete_months_only(spark):
    w = warehouse(spark, cash_gift=[cash(1, D(1999, 1, 31), 5), cash(1, D(1999, 2, 1), 7), cash(2, D(2001, 9, 1), 9), cash(3, D(2001, 8, 1), 1, "No")])
    got = {(r.constituent_id, r.month): int(r.cash_24_months) for r in fs.rolling_24_month_cash(w, AS_OF).collect()}
    assert got[1, 199901] == 5
    assert got[1, 199902] == 12
    assert got[1, 200012] == 12
    assert got[1, 200101] == 7
    assert (1, 200102) not in got
    assert {k[0] for k in got} == {1}


def status_of(spark, w, carried, lifespans):
    return fs.giver_status(fs.regular_giving_spans(spans(spark, carried), lives(spark, lifespans)), fs.rolling_cash_spans(w, AS_OF))


def test_giver_categories(spark):
    w = warehouse(spark, cash_gift=[cash(1, D(2001, 7, 1), 5), cash(2, D(2001, 7, 1), 6)])
    carried = [(1, 10, "DD", at(200106), at(200108), 12), (3, 30, "DD", at(200107), NOW, 24), (4, 40, "DD", at(200107), NOW, 1)]
    # Gift 30 was active at the end of July only; gift 40 has no final month and counts on.
    status = status_of(spark, w, carried, [(10, 0, 0, None), (30, 0, 0, 200107), (40, 0, 0, None)])
    assert rows(fs.per_month(status), "constituent_id", "month", "giver_category") == [
        (1, 200106, "Active CoG only"),
        (1, 200107, "Active CoG and Active Cash"),
        (1, 200108, "Active Cash only"),
        (2, 200107, "Active Cash only"),
        (2, 200108, "Active Cash only"),
        (3, 200107, "Active CoG only"),
        (4, 200107, "Active CoG only"),
        (4, 200108, "Active CoG only"),
    ]
    totals = rows(fs.file_size_actuals(status), "month", "giver_category", "people", F.col("regular_value").cast("int"))
    assert (200107, "Active CoG only", 2, 25) in totals
    assert (200108, "Active Cash only", 2, None) in totals


def test_organisations_leave_and_the_deceased_are_marked(spark):
    people = [
        person(1, key_indicator="O"),
        person(2, is_deceased="Yes", deceased_date=D(2001, 6, 30)),
        person(3, is_deceased="Yes", deceased_date=D(2001, 6, 29)),
        person(4, is_deceased="Yes", date_changed=D(2001, 7, 10)),
        person(5, is_deceased="Yes"),
        person(6, is_deceased="Yes", deceased_date=D(2001, 9, 14)),
        person(7, is_deceased="Yes", deceased_date=D(1950, 1, 1)),
    ]
    w = warehouse(spark, constituent=people)
    carried = [(i, i, "DD", at(200106), NOW, 1) for i in range(1, 8)]
    status = status_of(spark, w, carried, [(i, 0, 0, None) for i in range(1, 8)])
    marked = fs.per_month(fs.mark_deceased(w, fs.exclude_organisations(w, status)))
    first = {r.constituent_id: r.m for r in marked.filter("giver_category like 'Deceased - was %'").groupBy("constituent_id").agg(F.min("month").alias("m")).collect()}
    # The day after death falls in July for person 2, in June for person 3.
    assert first == {2: 200107, 3: 200106, 4: 200107, 7: 200106}
    assert marked.count() == 6 * 3
    assert marked.select("constituent_id", "month").distinct().count() == 6 * 3


def test_crossed_giving_keeps_givers_without_category(spark):
    def given(gift_id, key, kind, day_key, amount):
        return dict(gift_id=gift_id, constituent_key=key, gift_type_id=kind, gift_date_key=day_key, amount=amount)

    gifts = [given(1, 1, 31, 20010710, 5), given(2, 1, 31, 20010601, 7), given(3, 2, 1, 20010702, 3), given(4, 3, 31, 20010701, 9), given(5, 1, 31, 20010901, 1)]
    w = warehouse(
        spark,
        gift=gifts,
        constituent=[person(1), person(2), person(3, key_indicator="O")],
        cash_gift=[cash(2, D(2001, 7, 2), 3, gift_id=3)],
    )
    status = status_of(spark, w, [(1, 1, "DD", at(200107), NOW, 12)], [(1, 0, 0, None)])
    got = rows(fs.crossed_giving(w, status, AS_OF), "giver_category", "gift_type", "month", F.col("total").cast("int"))
    assert got == [
        (None, "RG Payment", 200106, 7),
        ("Active Cash only", "Cash", 200107, 3),
        ("Active CoG only", "RG Payment", 200107, 5),
    ]


def test_retention_labels_and_null_months(spark):
    w = warehouse(spark)
    carried = [
        (1, 10, "DD", at(200105), at(200108), 12),
        (1, 11, "DD", at(200105), at(200106), 6),
        (2, 12, "DD", at(200107), at(200108), 6),
        (3, 13, "DD", at(200107), at(200108), 2),
    ]
    lifespans = [(10, 200105, 200106, None), (11, 200105, 200106, None), (12, 200106, None, None), (99, 200101, 200102, None)]
    long = fs.retention_long(spans(spark, carried), lives(spark, lifespans))
    may = long.filter("month = 200105").collect()
    assert [(r.constituents, r.gifts, int(r.annual_amount)) for r in may] == [(1, 2, 18)]
    # A gift that never reaches a month stays, without a month; one without a lifespan too.
    assert rows(long.filter("month is null"), "setup_month", "cancel_month", "constituents", "gifts", "annual_amount") == [(200101, 200102, 0, 0, None)]
    assert long.filter("setup_month is null").count() == 1
    got = rows(fs.retention_by_mandate_age(w, long), "month", "cancellation_status", "months_since_setup", "gifts")
    assert (200105, "Cancelled in future", 0, 2) in got
    assert (200106, "Cancelled DURING this month", 1, 1) in got
    assert (200107, "Cancelled BEFORE this month", 2, 1) in got
    assert (200107, "Still active now", 1, 1) in got
    assert (None, "Still active now", None, 0) in got
