import random
from decimal import Decimal

from fixture import AS_OF, D, rows, warehouse
from pyspark.sql import functions as F

from givetide.operators import history as h
from givetide.operators import state as s
from givetide.sources.warehouse import settle

PAY = [dict(payment_type_id=1, payment_type="Direct Debit"), dict(payment_type_id=2, payment_type="Cheque")]


def gift(gift_id, **more):
    return dict(
        gift_id=gift_id, gift_system_id=gift_id + 100, constituent_key=1, gift_type_id=30, gift_status_id=1, gift_code_id=-1,
        payment_type_id=1, gift_date=D(2001, 1, 5), gift_date_key=20010105, changed_date_key=20010501,
    ) | more


def change(gift_id, sequence, key, amount, **more):
    return dict(
        change_id=gift_id * 100 + sequence, gift_id=gift_id, constituent_key=1, sequence=sequence, is_original=int(sequence == 1),
        change_date_key=key, amount=amount, annual_amount=amount, change_annual_amount=amount,
    ) | more


PERSON = [dict(constituent_key=1, constituent_id=11, key_indicator="I", is_deceased="No")]


def make(spark, gifts, changes, **more):
    return warehouse(spark, **{"gift": gifts, "gift_change": changes, "constituent": PERSON, "payment_type": PAY} | more)


def test_latest_change_of_a_month_wins(spark):
    w = make(spark, [gift(1)], [change(1, 1, 20010105, 12), change(1, 2, 20010120, 24), change(1, 3, 20010310, 36)])
    latest = s.latest_state_per_month(w, h.regular_gift_changes(w))
    assert rows(latest, "month", "sequence", F.col("annual_amount").cast("int")) == [(200101, 2, 24), (200103, 3, 36)]


def test_rows_that_share_the_top_sequence_are_kept(spark):
    w = make(spark, [gift(1)], [change(1, 1, 20010105, 12)])
    doubled = h.regular_gift_changes(w)
    doubled = doubled.unionByName(doubled)
    latest = s.latest_state_per_month(w, doubled)
    assert latest.count() == 2
    assert s.carry_forward_amounts(latest, AS_OF).count() == 8


def test_other_gift_types_have_no_history(spark):
    w = make(spark, [gift(1), gift(2, gift_type_id=31)], [change(1, 1, 20010105, 12), change(2, 1, 20010105, 12)])
    assert rows(h.regular_gift_changes(w), "gift_id") == [(1,)]


def test_top_rows_are_picked_before_the_shuffle(spark):
    w = make(spark, [gift(1)], [change(1, 1, 20010105, 12)])
    plan = s.latest_state_per_month(w, h.regular_gift_changes(w))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _literal_carry_forward(details, current):
    """Every detail row met with every later month; rows below the highest sequence leave."""
    met = {}
    for person, gift_id, month, sequence, kind, amount in details:
        for m in range(month, current):
            met.setdefault((person, gift_id, m), []).append((sequence, kind, amount))
    return {(k, r) for k, found in met.items() for r in found if r[0] == max(x[0] for x in found)}


def test_carry_forward_equals_the_literal_form_with_shuffled_sequences(spark):
    rng = random.Random(5)
    details = []
    for gift_id in range(40):
        months = rng.sample(range(24000, 24030), rng.randrange(1, 8))
        sequences = list(range(len(months)))
        rng.shuffle(sequences)
        details += [(gift_id % 7, gift_id, mth, q, "DD", rng.randrange(100)) for mth, q in zip(months, sequences, strict=True)]
    as_months = [(p, g, i // 12 * 100 + i % 12 + 1, q, k, Decimal(a)) for p, g, i, q, k, a in details]
    df = spark.createDataFrame(
        as_months, "constituent_id bigint, gift_id bigint, month int, sequence int, payment_type string, annual_amount decimal(19,4)"
    )
    got = s.carry_forward_amounts(df, AS_OF).withColumn("i", F.expr("month div 100 * 12 + month % 100 - 1")).collect()
    found = {((r.constituent_id, r.gift_id, r.i), (r.sequence, r.payment_type, int(r.annual_amount))) for r in got}
    assert len(got) == len(found)
    assert found == _literal_carry_forward(details, 2001 * 12 + 8)


def test_every_month_runs_from_first_change_to_last_complete_month(spark):
    w = make(spark, [gift(1), gift(2)], [change(1, 1, 20010620, 1), change(1, 2, 20010801, 1), change(2, 1, 20010905, 1)])
    assert rows(s.every_month_since_start(w, h.regular_gift_changes(w), AS_OF)) == [(1, 200106), (1, 200107), (1, 200108)]


def test_unrealistic_gifts(spark):
    codes = [dict(gift_code_id=1, gift_code_description="Website direct debit"), dict(gift_code_id=2, gift_code_description="SMS")]
    fact = dict(gift_status="Canceled", has_been_upgraded="No", annual_amount=1801)
    facts = [
        dict(gift_id=1) | fact,
        dict(gift_id=2) | fact | dict(annual_amount=1800),
        dict(gift_id=3) | fact | dict(gift_status="Held"),
        dict(gift_id=4) | fact | dict(has_been_upgraded="Yes"),
        dict(gift_id=5) | fact | dict(first_instalment_date=D(2001, 1, 1)),
        dict(gift_id=6) | fact,
        dict(gift_id=7) | fact | dict(gift_status=None),
    ]
    gifts = [gift(i, gift_code_id=2 if i == 6 else 1) for i in range(1, 8)]
    w = make(spark, gifts, [], rg_fact=facts, gift_code=codes)
    unwanted = s.unrealistic_gifts(w)
    assert rows(unwanted) == [(1,)]
    kept = s.without_gifts(spark.createDataFrame([(1,), (2,), (None,)], "gift_id bigint"), unwanted)
    assert rows(kept) == [(None,), (2,)]


STATUSES = [dict(gift_status_id=i, gift_status=n) for i, n in enumerate(["Active", "Held", "Terminated", "Completed", "Canceled"], 1)]


def test_lifespan_cases(spark):
    dated = dict(status_date=D(2001, 4, 20))
    cases = {
        1: (dict(gift_status_id=1), dated),
        2: (dict(gift_status_id=2), dated),
        3: (dict(gift_status_id=5), dated),
        4: (dict(gift_status_id=5, changed_date_key=20010601), dict(status_date=None)),
        5: (dict(gift_status_id=3, changed_date_key=19700101), None),
        6: (dict(gift_status_id=2), None),
    }
    gifts = [gift(i, **g) for i, (g, _) in cases.items()]
    dates = [dict(gift_system_id=i + 100, status="x") | d for i, (_, d) in cases.items() if d is not None]
    w = make(spark, gifts, [], gift_status=STATUSES, gift_status_date=dates)
    assert rows(s.gift_lifespan(w), "gift_id", "setup_month", "cancel_month", "final_active_month") == [
        (1, 200101, None, None),
        (2, 200101, None, 200103),
        (3, 200101, 200104, 200103),
        (4, 200101, 200106, 200105),
        (5, 200101, 197001, None),
        (6, 200101, None, None),
    ]


def _group_rows(spark, data):
    schema = """constituent_id bigint, gift_id bigint, month int, group_id int, sequence int, payment_type_id int,
        change_annual_amount decimal(19,4)"""
    return spark.createDataFrame([(*r[:5], 1, Decimal(r[5])) for r in data], schema)


def test_active_value_by_group_equals_the_literal_form(spark):
    rng = random.Random(9)
    data, sequence = [], {}
    for _ in range(200):
        gift_id = rng.choice([1, 1, 1, *range(2, 30)])
        sequence[gift_id] = sequence.get(gift_id, 0) + 1
        i = 24000 + rng.randrange(20)
        data.append((gift_id % 5, gift_id, i // 12 * 100 + i % 12 + 1, rng.choice([50, 51]), sequence[gift_id], Decimal(rng.randrange(-9, 99))))
    ended = {2: D(2001, 3, 5), 3: None, 4: D(2000, 1, 1), 5: D(2003, 6, 1)}
    status = [dict(gift_system_id=g + 100, status="Canceled", status_date=d) for g, d in ended.items()]
    status += [dict(gift_system_id=2 + 100, status="Terminated", status_date=D(2001, 5, 5)), dict(gift_system_id=106, status="Active")]
    w = make(spark, [gift(i) for i in range(1, 30)], [], gift_status_date=status)
    details = settle(s.latest_change_per_group_month(w, _group_rows(spark, data)))
    idx = lambda m: m // 100 * 12 + m % 100 - 1
    stops = {}
    for row in status:
        if row["status"] != "Active":
            d = row["status_date"]
            known = d is not None and d <= D(2002, 12, 31)
            stops.setdefault(row["gift_system_id"] - 100, []).append(
                (d.year * 12 + d.month - 1) if known else (1979 * 12 + 11 if d is None else None)
            )
    want = {}
    for r in details.collect():
        for stop in stops.get(r.gift_id, [None]):
            for i in range(idx(r.month), 2001 * 12 + 8):
                if stop is None or i < stop:
                    people, gifts, total = want.setdefault((i, r.group_id), (set(), set(), []))
                    people.add(r.constituent_id), gifts.add(r.gift_id), total.append(r.change_annual_amount)
    got = {(idx(r.month), r.group_id): (r.givers, r.gifts, r.value) for r in s.active_gift_value_by_group(w, details, AS_OF).collect()}
    assert got == {k: (len(p), len(g), sum(t)) for k, (p, g, t) in want.items()}


def test_a_change_under_two_groups_counts_in_each_with_all_its_rows(spark):
    data = [(1, 1, 200101, 50, 1, 10), (1, 1, 200101, 51, 1, 10), (1, 1, 200101, 50, 2, 5)]
    w = make(spark, [gift(1)], [])
    got = s.latest_change_per_group_month(w, _group_rows(spark, data))
    assert rows(got, "group_id", "sequence", F.col("change_annual_amount").cast("int")) == [(50, 2, 5), (51, 1, 10), (51, 1, 10)]


def test_totalled_changes_add_up_to_those_looked_up_one_by_one(spark):
    rng = random.Random(11)
    data = []
    for _ in range(400):
        # Sequences of a gift repeat, over groups, months and people; amounts, gifts and sequences may be unknown.
        gift_id, sequence = rng.choice([None, *range(1, 9)]), rng.choice([None, *range(1, 6)])
        data.append((rng.choice([None, 1, 2]), gift_id, rng.choice([200101, 200102]), rng.choice([None, 50, 51]), sequence, rng.choice([None, Decimal(rng.randrange(-9, 99))])))
    schema = "constituent_id bigint, gift_id bigint, month int, group_id int, sequence int, change_annual_amount decimal(19,4), payment_type_id int"
    wide = settle(spark.createDataFrame([(*r, rng.choice([1, 2, 2, 9, None])) for r in data], schema))
    w = make(spark, [], [], payment_type=[*PAY, PAY[1]])
    keys = ["constituent_id", "gift_id", "month", "group_id", "sequence", "payment_type"]
    one_by_one = s.latest_change_per_group_month(w, wide)
    totalled = s.totals_by_change(wide)
    got = s.latest_change_per_group_month(w, totalled, totalled=True)
    assert got.columns == one_by_one.columns
    # A payment type listed twice is met twice, as before.
    assert got.count() < one_by_one.count() and got.groupBy(*keys).count().filter("count > 2").isEmpty()
    total = lambda df: rows(df.groupBy(*keys).agg(F.sum("change_annual_amount").cast("double")))
    assert total(got) == total(one_by_one)
    assert totalled.count() == totalled.select(*[c for c in totalled.columns if c != "change_annual_amount"]).distinct().count()


def test_undated_cancellations_are_long_ago():
    assert s.LONG_AGO == 197912


def test_value_by_group_meets_the_cancellations_once(spark):
    from givetide.sources.roles import warehouse_of

    w = warehouse_of(spark, "/root/testdata/sf0.001")
    details = settle(s.latest_change_per_group_month(w, settle(h.grouped_changes(w))))
    assert "Join" not in s.active_gift_value_by_group(w, details, AS_OF)._jdf.queryExecution().executedPlan().toString()
