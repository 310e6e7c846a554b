import pytest
from fixture import rows, warehouse

from givetide.operators import constraints as c
from givetide.plans import active_gifts


def change(gift, sequence, day=20010105, **other):
    return {"gift_id": gift, "sequence": sequence, "change_date_key": day, **other}


def report(w, *rules):
    return {r[0]: tuple(r[1:]) for r in c.constraint_report(w, rules).collect()}


def test_repeated_keys_are_counted_with_the_largest(spark):
    w = warehouse(spark, gift_change=[change(1, 1), change(1, 1), change(1, 1), change(1, 2), change(2, 1), change(2, 1), change(None, 1), change(None, 1)])
    rule = c.unique("gift_change", "gift_id", "sequence")
    assert report(w, rule) == {"unique gift_change(gift_id, sequence)": (5, 2, 3, 14)}


def test_nulls_and_missing_references(spark):
    w = warehouse(spark, gift_change=[change(1, 1), change(1, None, 19800101), change(None, None, 19800101), change(3, 1, None)])
    found = report(w, c.filled("gift_change", "sequence"), c.filled("gift_change", "gift_id"), c.refers("gift_change", "change_date_key", "calendar", "date_key"))
    assert found == {
        "filled gift_change(sequence)": (2, None, None, None),
        "filled gift_change(gift_id)": (1, None, None, None),
        "refers gift_change(change_date_key) in calendar(date_key)": (2, 1, 2, None),
    }


def test_names_are_compared_as_joins_do(spark):
    w = warehouse(spark, appeal=[{"appeal_id": 1, "appeal_identifier": "AB/1"}, {"appeal_id": 2, "appeal_identifier": "ab/1 "}, {"appeal_id": 3}])
    assert report(w, c.unique("appeal", "appeal_identifier")) == {"unique appeal(appeal_identifier)": (2, 1, 2, 4)}


def test_fan_out_is_known_before_facts_are_joined(spark):
    w = warehouse(spark, appeal=[{"appeal_id": i, "appeal_identifier": "AB/1"} for i in range(1000)])
    rule = c.unique("appeal", "appeal_identifier")
    assert report(w, rule)[rule.name] == (1000, 1, 1000, 1_000_000)
    assert [r.rows_joined for r in c.require(w, [], most={rule: 1000})] == [1_000_000]
    with pytest.raises(ValueError, match=r"unique appeal\(appeal_identifier\): 1000 rows, 1000 of one key"):
        c.require(w, [], most={rule: 999})
    with pytest.raises(ValueError, match="watched on unique rules"):
        c.require(w, [], most={c.filled("appeal", "appeal_id"): 3})


def test_empty_tables_break_no_rule(spark):
    found = c.constraint_report(warehouse(spark)).collect()
    assert {r.failing_rows for r in found} == {0}
    assert len(found) == len(c.NEEDED) + len(c.NAMES)
    assert rows(c.constraint_report(warehouse(spark), [])) == []


def test_a_run_that_asks_for_the_pass_stops_before_it_writes(spark):
    written = []
    w = warehouse(spark, gift_change=[change(1, 1), change(1, 1)])
    with pytest.raises(ValueError, match=r"unique gift_change\(gift_id, sequence\): 2 rows, 2 of one key"):
        active_gifts.run(w, lambda df, name: written.append(name), check=True)
    assert written == []
