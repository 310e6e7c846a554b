import datetime as dt
from decimal import Decimal

import pytest
from fixture import rows, warehouse

from givetide.operators import rollup

TREE = "group_id int, forms_part_of int, level int, description string"


def tree(spark, *pairs):
    return spark.createDataFrame([(g, p, 0, f"g{g}") for g, p in pairs], TREE)


@pytest.mark.parametrize("depth", [1, 2, 3, 8, 21])
def test_a_chain_has_every_ancestor_at_its_distance(spark, depth):
    chain = tree(spark, *[(i, i + 1 if i < depth else None) for i in range(depth + 1)])
    assert rows(rollup.ancestors(chain)) == [(i, j, j - i) for i in range(depth + 1) for j in range(i, depth + 1)]


def test_unlisted_parents_repeated_rows_and_no_rows(spark):
    df = tree(spark, (1, 2), (1, 2), (3, 2), (4, None), (None, 4))
    assert rows(rollup.ancestors(df)) == [(1, 1, 0), (1, 2, 1), (3, 2, 1), (3, 3, 0), (4, 4, 0)]
    assert rows(rollup.ancestors(df.limit(0))) == []


@pytest.mark.parametrize("pairs", [[(1, 1)], [(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 3), (3, 1)], [(i, (i + 1) % 7) for i in range(7)]])
def test_a_circle_raises_an_error(spark, pairs):
    with pytest.raises(ValueError, match="forms part of itself"):
        rollup.ancestors(tree(spark, *pairs))


def test_two_parents_raise_an_error(spark):
    with pytest.raises(ValueError, match="group 1 is listed with more than one parent"):
        rollup.ancestors(tree(spark, (1, 2), (1, 3)))


def test_each_level_totals_what_is_below(spark):
    groups = spark.createDataFrame([(1, None, 5, "all"), (2, 1, 6, "half"), (3, 2, 7, "a"), (4, 2, 7, "b")], TREE)
    metrics = spark.createDataFrame(
        [("t", 200101, 3, Decimal(5)), ("t", 200101, 4, Decimal(7)), ("t", 200101, 2, Decimal(1)), ("t", 200102, 3, None), ("t", 200101, 9, Decimal(2)), ("t", 200101, None, Decimal(4))],
        "type string, month int, group_id int, total decimal(38,4)",
    )
    got = rows(rollup.metrics_by_level(metrics, groups), "month", "group_id", "level", "own_total", "total")
    assert got == rows(spark.createDataFrame([
        (200101, None, None, Decimal(4), Decimal(4)), (200101, 1, 5, None, Decimal(13)), (200101, 2, 6, Decimal(1), Decimal(13)), (200101, 3, 7, Decimal(5), Decimal(5)),
        (200101, 4, 7, Decimal(7), Decimal(7)), (200101, 9, None, Decimal(2), Decimal(2)), (200102, 1, 5, None, None), (200102, 2, 6, None, None), (200102, 3, 7, None, None),
    ], "month int, group_id int, level int, own_total decimal(38,4), total decimal(38,4)"))


def test_someone_in_two_groups_counts_once_above_them(spark):
    groups = spark.createDataFrame([(1, None, 5, "all"), (2, 1, 6, "half"), (3, 2, 7, "a"), (4, 2, 7, "b")], TREE)
    data = [(1, 1, 200107, 3, 1, 10), (1, 1, 200108, 4, 2, 5), (1, 2, 200107, 4, 1, 2), (2, 3, 200108, 3, 1, 7), (3, 4, 200108, 9, 1, None), (3, 5, 200108, None, 1, 1), (2, 6, 200108, 2, 1, 4)]
    details = spark.createDataFrame(
        [(p, g, m, k, n, None if v is None else Decimal(v)) for p, g, m, k, n, v in data],
        "constituent_id int, gift_id int, month int, group_id int, sequence int, change_annual_amount decimal(19,4)",
    )
    gifts = [dict(gift_id=i, gift_system_id=i + 100, gift_type_id=30) for i in range(1, 7)]
    w = warehouse(spark, gift=gifts, gift_status_date=[dict(gift_system_id=102, status="Canceled", status_date=dt.date(2001, 8, 3))])
    got = rollup.active_gifts_by_level(w, details, groups, dt.date(2001, 9, 5))
    want = {}
    above = {3: (3, 2, 1), 4: (4, 2, 1), 2: (2, 1)}
    for p, g, m, k, _, v in data:
        for month in (200107, 200108):
            if m <= month and not (g == 2 and month == 200108):
                for a in above.get(k, (k,)):
                    people, pairs, gifts, total = want.setdefault((month, a), (set(), set(), set(), []))
                    people.add(p), pairs.add((p, k)), gifts.add(g), total.append(v)
    value = lambda t: sum(v for v in t if v is not None) if any(v is not None for v in t) else None
    assert {(r.month, r.group_id): (r.givers, r.givers_summed, r.gifts, r.value) for r in got.collect()} == {
        k: (len(p), len(q), len(g), value(t)) for k, (p, q, g, t) in want.items()
    }
    assert {(r.group_id, r.forms_part_of, r.level) for r in got.collect()} == {(1, None, 5), (2, 1, 6), (3, 2, 7), (4, 2, 7), (9, None, None), (None, None, None)}
    assert rollup.active_gifts_by_level(w, details.limit(0), groups, dt.date(2001, 9, 5)).count() == 0
