"""One row per rule arm, and rows that meet two arms to fix the order."""

import pytest
from pyspark.sql import functions as F

from givetide.functions.rules import begins, first_match, is_, number, rule
from givetide.operators.groups import classify_cash, classify_event, classify_pack, classify_regular, classify_rg_income

RULES = [(f"d{n}", 40 + n, n) for n in (0, 4, 5, 6, 7, 17, 20, 21, 22, 23, 24, 26, 99)] + [
    ("SRec - Zero", 77, 0),
    ("Event - Zero", 78, 0),
]
HV, ST, P2P = "High Value Supporter", "Small Trusts", "Peer to Peer Fundraiser"
UP = "Regular Gifts - Upgrade and Reactivation"
NW = "Non-Welcome upgrade appeal"

# descriptor, product, audience, appeal type, package category -> NEW, CHANGE, CANCEL, WIDE
REGULAR = [
    (("d0", "Direct Solicited Donations", HV, "Other", None), 73, 73, 73, 73),
    (("d0", "donor reporting", HV.upper(), "Other", None), 72, 72, 72, 72),
    (("d0", "x", HV, "Other", None), 40, 40, 40, 71),
    (("SREC anything", "Regular Gifts - Doordrop", None, "Other", None), 52, None, None, 52),
    (("SRec - Zero", "Regular Gifts - Doordrop", None, "Other", None), 52, 77, 52, 52),
    (("SRec - Zero", "Regular Gifts - BRTV", None, "Other", None), 63, 77, 63, 63),
    (("SRec - Zero", "Regular Gifts - Inserts", None, "Other", None), 35, 77, 35, 35),
    (("SRec - Zero", "Regular Gifts - Word of Mouth", None, "Other", None), 62, 77, 62, 62),
    (("SRec - Zero", None, None, "Other", None), 77, 77, 77, 77),
    (("d0", None, None, "Other", None), 40, 40, 40, 40),
    (("D0", None, None, "Other", None), 40, 40, 40, 40),
    (("d4", "PPC", ST, "Other", None), 75, 75, 75, 75),
    (("d21", None, ST, "Other", None), 75, 75, 75, 75),
    (("d4", "PPC", None, "Other", None), 45, 45, 45, 45),
    (("d4", "Social Media Advertising", None, "Other", None), 61, 61, 61, 61),
    (("d4", None, None, "Other", None), 39, 39, 39, 39),
    (("d21", "ppc", None, "Other", None), 45, 45, 45, 45),
    (("d21", "Social Media Advertising", None, "Other", None), 61, 61, 61, 61),
    (("d21", None, None, "Other", None), 39, 39, 39, 39),
    (("d5", None, None, "Other", None), 51, 51, 51, 51),
    (("d6", "PPC", None, "Other", None), 45, 45, 45, 45),
    (("d6", "Social Media Advertising", None, "Other", None), 61, 61, 54, 61),
    (("d6", None, None, "Other", None), 54, 54, 54, 54),
    (("d7", "PSMS - DRTV", None, "Other", None), 55, 55, 55, 55),
    (("d7", None, None, "Other", None), 33, 33, 33, 33),
    (("d17", None, None, "Other", None), 999, 999, 999, 72),
    (("d23", UP, HV, "Welcome", "Telephone"), 79, 79, 79, 71),
    (("d23", UP, HV, "Other", "Direct Mail"), 78, 78, 78, 71),
    (("d23", UP, None, "Welcome", "Telephone"), 37, 37, 37, 37),
    (("d23", UP, None, "Welcome", "Direct Mail Reminder"), 64, 64, 64, 64),
    (("d23", UP, None, NW, "telephone"), 65, 65, 65, 65),
    (("d23", UP, None, NW, "Direct Mail"), 66, 66, 66, 66),
    (("d23", UP, None, "Other", "Telephone"), 50, 50, 50, 50),
    (("d20", "PPC", None, "Other", None), 45, 45, 45, 45),
    (("d20", "Social Media Advertising", None, "Other", None), 61, 61, 61, 61),
    (("d20", None, None, "Other", None), 50, 50, 50, 50),
    (("d22", None, None, "Other", None), 50, 50, 50, 50),
    (("d24", None, None, "Other", None), 49, 49, 49, 49),
    (("d26", None, None, "Other", None), 53, 53, 53, 53),
    (("d99", None, None, "Other", None), 999, 999, 999, 999),
    (("unknown", "PPC", None, "Other", None), 999, None, None, 999),
    ((None, None, None, "Other", None), 999, None, None, 999),
]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(RULES, "descriptor string, default_group int, rule_number int")


@pytest.mark.parametrize("variant", ["NEW", "CHANGE", "CANCEL", "WIDE"])
def test_regular_arms(spark, known, variant):
    at = ["NEW", "CHANGE", "CANCEL", "WIDE"].index(variant)
    rows = [(i, *case[0]) for i, case in enumerate(REGULAR)]
    df = spark.createDataFrame(
        rows, "i int, descriptor string, product string, audience string, appeal_type string, package_category string"
    )
    got = {r.i: r.group_id for r in classify_regular(variant, df, known).collect()}
    want = {i: case[1 + at] for i, case in enumerate(REGULAR) if case[1 + at] is not None}
    assert got == want


CASH = [
    (("d0", "Direct Solicited Donations", HV, None, True), 73),
    (("d0", "Donor Reporting", HV, None, True), 72),
    (("d0", None, HV, None, True), 71),
    (("Event - Zero", "Glastonbury Festival", P2P, None, True), 58),
    (("Events - Half Marathon", None, P2P, None, False), 84),
    (("Comm - Run In Celebration", None, P2P, None, False), 86),
    (("Events - Running In Celebration", None, P2P, None, False), 84),
    (("Event - Zero", "Glastonbury Festival", P2P, None, False), 87),
    (("d0", "Glastonbury Festival", "Schools", None, False), 26),
    (("d0", "Tough Sh!t", None, None, False), 88),
    (("comm - walking", None, "Schools", None, False), 25),
    (("Event - Zero", None, "Schools", None, False), 27),
    (("d0", None, "Faith Groups", None, False), 28),
    (("d0", None, "Schools", None, False), 29),
    (("d0", None, "Local Groups", None, False), 89),
    (("d0", None, "Choir Groups", None, False), 91),
    (("d0", None, "Youth Groups", None, False), 92),
    (("d0", None, "Universities", None, False), 93),
    (("d0", None, "Other Women's Groups", None, False), 30),
    (("SRec - Zero", "Regular Gifts - Inserts", None, None, False), 35),
    (("d0", None, None, None, False), 40),
    (("d4", None, ST, None, False), 75),
    (("d5", None, None, "the WAHOO code", False), 46),
    (("d5", "Wahoo Gifting", None, None, False), 46),
    (("d5", None, None, None, False), 51),
    (("d6", None, None, None, False), 53),
    (("d6", "PPC", None, None, False), 45),
    (("d7", "PSMS - DRTV", None, None, False), 55),
    (("d7", None, None, None, False), 33),
    (("d20", "PPC", None, None, False), 45),
    (("d22", None, None, None, False), 50),
    (("d23", UP, None, None, False), 50),
    (("d24", None, None, None, False), 49),
    (("d26", None, None, None, False), 53),
    (("d17", None, None, None, False), 999),
    (("unknown", None, None, None, None), 999),
]


def test_cash_arms(spark, known):
    df = spark.createDataFrame(
        [(i, *case) for i, (case, _) in enumerate(CASH)],
        "i int, descriptor string, product string, audience string, gift_code string, rolling_sms boolean",
    )
    got = {r.i: r.group_id for r in classify_cash(df, known).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASH)}


NOW, BEFORE, CHANGED = (
    "Gift started during this financial year",
    "Gift started before this financial year",
    "Gift amended during this financial year",
)
INCOME = [
    (("anything", "Direct Debit", BEFORE, None, "SMS"), 69),
    (("Legacy Team", "Direct Debit", BEFORE, None, None), 998),
    (("Comm - Not Categorised", "Direct Debit", BEFORE, None, None), 31),
    (("Community Team - High Value", "Direct Debit", BEFORE, None, None), 68),
    (("Events Team - x", None, None, None, None), 27),
    (("SDev - Upgrade", "Direct Debit", NOW, None, None), 82),
    (("SDev - Upgrade", "Direct Debit", BEFORE, CHANGED, None), 82),
    (("SDev - Upgrade", "Cheque", BEFORE, CHANGED, None), 83),
    (("SDEV - UPGRADE", "Cheque", BEFORE, None, None), 76),
    (("SDev - High Value", "Direct Debit", None, None, None), 68),
    (("SDev - High Value", "Cheque", None, None, None), 76),
    ((None, "Direct Debit", BEFORE, None, None), 68),
    ((None, "Cheque", BEFORE, None, None), 76),
    (("SRec - x", "Direct Debit", NOW, None, None), 80),
    (("SRec - x", "Cheque", NOW, None, None), 81),
    # A NULL payment type is neither equal to nor different from Direct Debit.
    (("SRec - x", None, NOW, None, None), None),
    (("SDev - x", "Cheque", None, None, None), None),
]


def test_income_arms(spark):
    df = spark.createDataFrame(
        [(i, *case) for i, (case, _) in enumerate(INCOME)],
        "i int, descriptor string, payment_type string, started string, amended string, gift_code string",
    )
    got = {r.i: r.group_id for r in classify_rg_income(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(INCOME)}


def test_event_and_pack_arms(spark):
    peer, mass = "Peer to peer event", "WaterAid Mass Participation Event"
    events = [
        ((peer, "FR Event - Cycling"), (84, 24)),
        ((peer, "fr event - dinner"), (85, 24)),
        ((peer, "FR Event - Celebration"), (86, 24)),
        ((peer, "FR Event - Other"), (87, 24)),
        ((mass, "FR Event - Cycling"), (88, 13)),
        (("Other", "FR Event - Marathon"), (25, 13)),
        (("Other", "FR Event - Dinner"), (27, 13)),
    ]
    df = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(events)], "i int, event_type string, action_type string")
    got = {r.i: (r.group_id, r.forms_part_of) for r in classify_event(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(events)}
    packs = spark.createDataFrame([("School",), ("Faith Group",), ("Neither",)], "constituent_type string")
    rows = classify_pack(packs).orderBy(F.col("group_id")).collect()
    assert [(r.group_id, r.forms_part_of, r.level) for r in rows] == [(28, 14, 8), (29, 14, 8), (31, 14, 8)]


def test_the_wide_rules_are_small_enough_for_the_jvm_to_compile(spark):
    """HotSpot interprets methods of over 8,000 bytes, however often they run."""
    import re

    from givetide.operators.history import grouped_changes
    from givetide.sources.roles import warehouse_of

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = grouped_changes(warehouse_of(spark, "/root/testdata/sf0.001"))._jdf.queryExecution()
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000


def test_numbered_values_and_shared_tests_read_like_plain_ones(spark):
    rules = [
        rule(1, a=is_("One", "two"), b=begins("x")),
        rule(2, a=is_("TWO"), n=number(0, 3)),
        rule(3, b=begins("x"), n=number(-1)),
        rule("n", a=is_("it's")),
    ]
    values = [(a, b, n) for a in ("one", "TWO  ", " two", "It's", "other", "", None) for b in ("Xy", "y", None) for n in (-2, -1, 0, 3, 4, None)]
    df = spark.createDataFrame(values, "a string, b string, n int")

    def want(a, b, n):
        a, x = None if a is None else a.lower().rstrip(" "), b is not None and b.lower().startswith("x")
        if a in ("one", "two") and x:
            return 1
        if a == "two" and n in (0, 3):
            return 2
        if x and n == -1:
            return 3
        return n if a == "it's" else 9

    got = first_match(df, rules, 9)
    assert got.columns == ["a", "b", "n", "group_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*v, want(*v))) for v in values)
