import datetime as dt
from decimal import Decimal

from fixture import AS_OF, D, rows, table, warehouse
from pyspark.sql import functions as F

from givetide.functions.rules import named_values
from givetide.operators import actions, fill, history, income, targets
from givetide.operators.groups import CASH_RULES, REGULAR_RULES
from givetide.operators.metrics import KEYS, cash_metric, regular_metric


def test_descriptor_labels_and_nulls(spark):
    data = [("CF/IS", "x"), ("cf/is/up", None), ("New Team", "Spring"), ("New Team", None), (None, "Spring")]
    df = spark.createDataFrame(data, "team string, campaign string")
    got = [r[0] for r in df.select(history.descriptor(F.col("team"), F.col("campaign"))).collect()]
    assert got == ["SDev - Appeal Unknown", "SDev - Upgrade Activity", "New Team - Spring", None, None]


def test_upgrade_appeals_the_campaign_overrides_every_exclusion(spark):
    def appeal(i, ident, descr="x", campaign=1):
        return dict(appeal_id=i, appeal_identifier=ident, appeal_description=descr, campaign_id=campaign)

    appeals = [
        appeal(1, "13/up1"), appeal(2, "RA/UP1"), appeal(3, "14/UP", "unallocated"), appeal(4, "15/UP", "Unicef"),
        appeal(5, "RA/X", "Unallocated", 2), appeal(6, "16/CA"), appeal(7, "13/up1"),
    ]
    campaigns = [dict(campaign_id=1, campaign_description="x"), dict(campaign_id=2, campaign_description="upgrade activity")]
    w = warehouse(spark, appeal=appeals, campaign=campaigns)
    assert rows(history.upgrade_appeals(w.appeal, w.campaign)) == [("13/up1",), ("RA/X",)]
    kinds = dict(rows(history.appeal_types(w.appeal, w.campaign)))
    assert kinds == {
        "13/up1": "Non-Welcome upgrade appeal", "RA/UP1": "Non-Welcome upgrade appeal", "14/UP": "Non-Welcome upgrade appeal",
        "15/UP": "Non-Welcome upgrade appeal", "RA/X": "Non-Welcome upgrade appeal", "16/CA": "Other",
    }
    welcome = spark.createDataFrame([("13/UPR9",)], "a string").select(history.appeal_type(F.col("a"), F.lit(True)))
    assert rows(welcome) == [("Welcome",)]


def test_rolling_sms(spark):
    packages = [
        dict(package_id=i, package_identifier=p, package_category=c)
        for i, (p, c) in enumerate([("13/CAC/01", "SMS"), ("13/cad/02", "sms"), ("13/CAC/03", "SMS"), ("13/CAE/04", "SMS"), ("14/CAC/05", "Mail")])
    ]
    got = rows(history.rolling_sms_appeals(table(spark, "package", packages)))
    assert got == [("13/CAC",), ("13/cad",)]


def _regular(spark, **more):
    base = dict(
        gift=[dict(gift_id=1, gift_system_id=101, constituent_key=1, gift_type_id=30, gift_status_id=5, gift_code_id=-1, payment_type_id=1)],
        constituent=[dict(constituent_key=1, constituent_id=11)],
        instalment_frequency=[dict(frequency_id=1, instalments_per_year=12), dict(frequency_id=2, instalments_per_year=4)],
        gift_code=[dict(gift_code_id=-1, gift_code_description="never used")],
    )
    return warehouse(spark, **(base | more))


def _change(sequence, **more):
    return dict(
        change_id=sequence, gift_id=1, constituent_key=1, sequence=sequence, is_original=int(sequence == 1), change_date_key=20010105,
        amount=10, annual_amount=120, change_amount=3, change_annual_amount=20, frequency_id=1, previous_frequency_id=2,
    ) | more


def test_history_amounts_frequencies_and_defaults(spark):
    w = _regular(spark, gift_change=[_change(1), _change(2), _change(3, previous_frequency_id=1), _change(4, frequency_id=9)])
    got = rows(
        history.rg_history(w), "sequence", "previous_instalments_per_year", "frequency_changed", "previous_instalment_amount",
        "adjusted_change_amount", "dash_group", "gift_code", "descriptor",
    )
    assert got == [
        (1, None, "No", None, 3.0, 999, None, None),
        (2, 4, "Yes", 25.0, -15.0, 999, None, None),
        (3, 12, "No", Decimal("8.333333333333333"), Decimal("1.666666666666667"), 999, None, None),
        (4, 4, "Yes", 25.0, -15.0, 999, None, None),
    ]


def test_movements_drop_unknown_appeals_and_fan_out_on_shared_names(spark):
    appeal = dict(appeal_category="CF/IS", campaign_description="c", campaign_id=1)
    w = _regular(
        spark,
        gift_change=[_change(1, appeal_id=1, package_id=1), _change(2, appeal_id=7), _change(3, appeal_id=1, change_annual_amount=0)],
        appeal=[dict(appeal_id=1, appeal_identifier="A", product="p") | appeal, dict(appeal_id=2, appeal_identifier="a", product="q") | appeal],
        package=[
            dict(package_id=1, package_identifier="P1", package_description="Letter", package_category="Mail"),
            dict(package_id=2, package_identifier="P2", package_description="letter", package_category="Phone"),
        ],
        gift_status_date=[dict(gift_system_id=101, status="terminated", status_date=D(2001, 5, 9)), dict(gift_system_id=101, status="Held")],
    )
    changes = history.rule_history(w)
    new = rows(history.new_gift_facts(w, changes), "product", "package_category", "month")
    # Two appeals share the identifier (twice over), two packages the description.
    assert sorted(new) == sorted([(p, c, 200101) for p in "pq" for c in ("Mail", "Phone") for _ in range(2)])
    assert history.amendment_facts(w, changes).count() == 0
    ended = history.cancellation_facts(w, changes)
    assert rows(ended.filter("package_category = 'Mail'"), "month", F.col("value").cast("int")) == [(200105, -20)] * 4
    by_identifier = history.rule_history(w, "package_identifier")
    assert {r.package_category for r in by_identifier.filter("sequence = 1").collect()} == {"Mail"}
    # Wide groups keep the change without an appeal, and agree with the full history.
    assert history.grouped_changes(w).filter("sequence = 2").count() == 1
    full = history.widened_history(w, history.rg_history(w, carry=True))
    columns = ["gift_id", "month", "group_id", "sequence", "change_annual_amount"]
    assert rows(full, *columns) == rows(history.grouped_changes(w), *columns)


def test_counted_changes_stand_for_all_packages_of_a_name(spark):
    def package(i, name, category):
        return dict(package_id=i, package_identifier=f"P{i}", package_description=name, package_category=category)

    shared = [package(i, "Letter " if i % 2 else "letter", ["Mail", "Phone", None][i % 3]) for i in range(30)]
    w = _regular(
        spark,
        gift_change=[_change(1, appeal_id=1, package_id=1), _change(2, appeal_id=1, package_id=40), _change(3, appeal_id=1), _change(4, appeal_id=1, package_id=99), _change(5, appeal_id=1, package_id=50)],
        appeal=[dict(appeal_id=1, appeal_identifier="A", product="p", appeal_category="CF/IS", campaign_description="c", campaign_id=1)],
        # One identifier stands twice, one package has no name.
        package=[*shared, shared[1], package(40, "Card", "Mail"), package(50, None, "Mail")],
    )
    columns = ["gift_id", "sequence", "change_annual_amount", "package_category"]
    counted, whole = history.rule_history(w, counted=True), history.rule_history(w)
    assert counted.filter("sequence = 1").count() == 3 and whole.filter("sequence = 1").count() == 62
    assert rows(counted.selectExpr(*columns, "explode(sequence(1, copies))").drop("col")) == rows(whole, *columns)
    totals = [rows(regular_metric(w, history.amendment_facts(w, x), "m", "NEW")) for x in (counted, whole)]
    assert totals[0] == totals[1] and len(totals[0]) == 1
    totals = [rows(regular_metric(w, history.new_gift_facts(w, x), "m", "NEW"), "total") for x in (counted, whole)]
    assert totals[0] == totals[1] == [(Decimal(62 * 20),)]


def test_values_that_no_rule_names_are_one(spark):
    data = [("High Value Supporter ", "PPC", "x", True), ("Warm", "General", "Event - Running", False), (None, "ppc ", None, None)]
    df = spark.createDataFrame(data, "audience string, product string, descriptor string, rolling_sms boolean")
    assert named_values(df, CASH_RULES).collect() == [
        ("high value supporter", "ppc", "x", True), (None, None, "Event - Running", False), (None, "ppc", None, None),
    ]
    facts = [(200101, "SRec - x", None, a, None, None, 1) for a in ("Warm", "Cold", "warm", None, "High Value Supporter")]
    seen = named_values(spark.createDataFrame(facts, "month int, descriptor string, product string, audience string, appeal_type string, package_category string, value int"), REGULAR_RULES["NEW"])
    assert seen.distinct().count() == 2


def test_cash_audience_override_needs_an_audience_on_the_appeal(spark):
    gift = lambda i, appeal: dict(
        gift_id=i, constituent_key=1, gift_type_id=1, gift_code_id=-1, team_id=1, appeal_id=appeal, gift_date_key=20010105, amount=i
    )
    override = lambda i: dict(gift_id=i, attribute_category="Target Audience", attribute_description="Schools")
    w = warehouse(
        spark,
        gift=[gift(1, 1), gift(2, 1), gift(3, 2), gift(4, None)],
        constituent=[dict(constituent_key=1, constituent_id=11)],
        team=[dict(team_id=1, team="NF")],
        appeal=[dict(appeal_id=1, appeal_identifier="A"), dict(appeal_id=2, appeal_identifier="B")],
        appeal_attribute=[
            dict(appeal_id=1, attribute_category="Target Audience", attribute_description="Lions"),
            dict(appeal_id=2, attribute_category="Product", attribute_description="PPC"),
        ],
        gift_attribute=[override(2), override(3)],
        group=[dict(group_id=29, description="Schools", forms_part_of=14, level=8)],
    )
    facts = income.cash_gift_facts(w)
    assert rows(facts, "gift_id", "audience", "product") == [(1, "Lions", None), (2, "Schools", None), (3, None, "PPC")]
    # Group 29 is listed; 30 and 999 are not and lose their id.
    got = rows(cash_metric(w, facts), "group_id", "description", F.col("total").cast("int"))
    assert got == [(None, None, 4), (29, "Schools", 2)]


def test_event_signups_and_packs(spark):
    action = lambda i, key, status, kind, day: dict(
        action_id=i, action_system_id=i + 50, constituent_key=key, action_status_id=status, action_type_id=kind,
        action_date_key=day.year * 10000 + day.month * 100 + day.day, action_date=day,
    )
    day = D(2001, 6, 10)
    w = warehouse(
        spark,
        action=[action(1, 1, 1, 1, day), action(2, 1, 1, 1, day), action(3, 1, 9, 1, day), action(4, 1, 3, 2, day), action(5, 1, 3, 2, day),
                action(6, 1, 3, 2, D(2001, 6, 11)), action(7, 2, 3, 2, D(2001, 10, 2))],
        action_status=[dict(action_status_id=1, action_status="accepted"), dict(action_status_id=3, action_status="Sent")],
        action_type=[dict(action_type_id=1, action_type="FR Event - Cycling"), dict(action_type_id=2, action_type="FR Pack - Info")],
        action_extra=[dict(action_system_id=51, date_added=D(2001, 5, 1)), dict(action_system_id=52, date_added=D(2001, 11, 1)),
                      dict(action_system_id=53, date_added=D(2001, 5, 1))],
        action_attribute=[dict(action_id=i, attribute_category="event name", attribute_description="Ride") for i in (1, 2, 3)],
        constituent=[dict(constituent_key=1, constituent_id=11), dict(constituent_key=2, constituent_id=12)],
        constituent_code=[dict(constituent_key=1, constituent_code="Schools"), dict(constituent_key=1, constituent_code="Other")],
    )
    assert rows(actions.event_signups(w)) == [(2001, 200105, "Ride", "Neither", "Other", "", "FR Event - Cycling", 20010610, 1)]
    # Once per day and type; a person with two codes counts under both types.
    assert rows(actions.pack_sends(w), "constituent_type", "sends") == [("Neither", 2), ("School", 2)]
    filled = actions.event_signups_filled(w, actions.event_signups(w), AS_OF)
    assert rows(filled, "month", "signups") == [(200105, 1), (200106, 0), (200107, 0), (200108, 0), (200109, 0)]


def test_zero_fill_starts_at_the_first_month_and_treats_nulls_as_one_key(spark):
    df = spark.createDataFrame([("a", 200106), ("a", 200108), (None, 200108), (None, 200108), ("z", 200112)], "k string, month int")
    got = rows(fill.zero_fill_since_first(df, ["k"], 2001 * 12 + 8))
    assert got == [(None, 200109), ("a", 200107), ("a", 200109)]


def metric(kind, month, group, total, descr="g"):
    return (kind, month, group, 10, 8, descr, Decimal(total))


SCHEMA = "type string, month int, group_id int, forms_part_of int, level int, description string, total decimal(38,4)"


def test_fiscal_fill_includes_months_before_the_first_activity(spark):
    w = warehouse(spark, group=[dict(group_id=1, description="one", forms_part_of=10, level=8)])
    df = spark.createDataFrame([metric("T", 200106, 1, 5), metric("T", 200106, None, 5), metric("T", None, 1, 5)], SCHEMA)
    added = fill.fill_missing_fiscal_months(df, w.months, w.group)
    months = [200104, 200105, 200107, 200108, 200109]
    assert rows(added, "group_id", "month", "description") == [(None, mth, None) for mth in months] + [(1, mth, "one") for mth in months]
    assert {int(r.total) for r in added.collect()} == {0}
    everything = df.unionByName(added)
    assert everything.select(*KEYS[:3]).distinct().count() == everything.count()


def test_targets_year_to_date_and_unmet(spark):
    target = lambda kind, month, group, value: dict(
        type=kind, month=month, group_id=group, forms_part_of=10, level=8, description="g", target=value
    )
    goals = [target("T", 200104, 1, 4), target("T", 200105, 1, 0), target("T", 200112, 1, 9), target("U", 200104, 2, 7), target("U", 200003, 2, 1), target("T", 200109, 1, 50)]
    w = warehouse(spark, target=goals)
    actual = spark.createDataFrame(
        [metric("T", 200104, 1, 5), metric("T", 200105, 1, 6), metric("T", 200109, 1, 100), metric("T", 200106, 1, 3), metric("T", 199912, 1, 8), metric("V", 200003, 3, 1)],
        SCHEMA,
    )
    compared = targets.compare_to_targets(actual, w.target, w.months, AS_OF)
    got = {(r.type, r.month): r for r in compared.collect()}
    assert (None, None) in got and got[None, None].over_under is None
    assert ("T", 199912) not in got
    april = got["T", 200104]
    assert (april.target, april.over_under, april.pct_over_under, april.is_in_current_fy) == (4, 1, 25.0, 1)
    assert (got["T", 200105].target, got["T", 200105].pct_over_under) == (0, None)
    assert (got["T", 200106].target, got["T", 200106].over_under) == (0, 3)
    assert (got["T", 200109].is_current_month, got["V", 200003].is_in_current_fy) == (1, 0)
    ahead = targets.future_targets(compared, w.target, w.months)
    assert rows(ahead, "type", "month", "is_current_month", "is_future_month", F.col("target").cast("int"), "over_under") == [("T", 200112, 0, 1, 9, None)]
    working = compared.unionByName(ahead)
    assert rows(targets.zero_income_ytd_targets(working, w.target, w.months), "type", F.col("ytd_target").cast("int")) == [("U", 7)]
    ytd = targets.ytd_results(working, w.target, w.months, AS_OF)
    of_t = {(int(r.ytd_actual), int(r.ytd_target), r.ytd_pct_over_under) for r in ytd.filter("type = 'T'").collect()}
    # September is the current month and does not count; neither does December's target.
    assert of_t == {(14, 4, 250.0)}
    assert rows(ytd.filter("type = 'U'"), "month", "ytd_actual", F.col("ytd_target").cast("int"), F.col("over_under").cast("int")) == [(200003, None, 7, -1), (200104, None, 7, -7)]
    assert ytd.filter("type = 'V'").count() == 0


def test_trends_number_before_dropping_recent_months(spark):
    w = warehouse(spark)
    df = spark.createDataFrame(
        [metric("T", 200106, 1, 1), metric("T", 200109, 1, 1), metric("T", 200107, 1, 1), metric("ActualReceivedRGIncome", 200106, 1, 1), metric("T", 200108, 1, 1)],
        SCHEMA,
    )
    got = targets.long_term_trends(df, w.months, dt.datetime(2001, 9, 15))
    # 31 August is 15 days before 15 September: not long enough ago.
    assert rows(got, "month", "sequence", "month_number", "fiscal_year") == [(200106, 1, 6, 2002), (200107, 2, 7, 2002)]


def test_nonfinancial_targets(spark):
    goal = lambda team, what, sub, month: dict(
        team=team, target_category="c", target_description=what, subcategory=sub, month=month, target_value=3
    )
    packs, faith = "Count of pack requests made in month", "Count of distinct faith groups making donation in month"
    w = warehouse(
        spark,
        newer=[dict(constituent_key=1, key_indicator="O", organisation_type="Faith Groups"), dict(constituent_key=2, key_indicator="I", organisation_type="Faith Groups")],
        material_sent=[
            dict(material_id=1, item="Primary School Pack", quantity=2, letter_activity_id=5),
            dict(material_id=2, item="secondary school pack", quantity=3, letter_activity_id=5),
            dict(material_id=3, item="Primary School Pack", quantity=9, letter_activity_id=-1),
            dict(material_id=4, item="Mystery Pack", quantity=9, letter_activity_id=5),
        ],
        activity=[dict(activity_id=5, end_date_key=20010610), dict(activity_id=-1, end_date_key=20010610)],
        nonfinancial_target=[
            goal("Community and Events", packs, "Water Resource pack request", 200106),
            goal("Community and Events", packs, "Water Resource pack request", 200107),
            goal("Digital", packs, "Water Resource pack request", 200106),
            goal("Any", faith, "All", 200106),
            goal("Any", faith, "All", 200107),
        ],
        payment=[
            dict(payment_id=1, constituent_key=1, donation_date_key=20010601, amount=5),
            dict(payment_id=2, constituent_key=1, donation_date_key=20010609, amount=6),
            dict(payment_id=3, constituent_key=2, donation_date_key=20010609, amount=7),
        ],
    )
    assert rows(targets.pack_requests_vs_target(w), "month", "actual_value", "extra_stat_value") == [(200106, 2, 5), (200107, 0, 0)]
    assert rows(targets.faith_groups_vs_target(w), "month", "faith_groups", F.col("amount_given").cast("int")) == [(200106, 1, 11), (200107, None, None)]
