"""Reporting-group rules: which group a gift, payment, sign-up or pack belongs to.

All literals below are fixed values of the reporting scheme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.functions import text
from givetide.functions.rules import (
    Rule,
    begins,
    begins_with_none,
    both,
    first_match,
    has,
    holds,
    is_,
    is_not,
    lacks,
    number,
    rule,
)

UNGROUPED = 999

HIGH_VALUE = is_("High Value Supporter")
UPGRADES = is_("Regular Gifts - Upgrade and Reactivation")
MAIL = is_("Direct Mail", "Direct Mail Reminder")
PHONE = is_("Telephone")
RECRUITMENT = begins("Supporter Recruitment", "SRec")
EVENT_OR_COMMUNITY = begins("Event", "Comm")
PEER = is_("Peer to Peer Fundraiser")

ACTIVE_WORDS = (
    "Running", "Walking", "Climbing", "Cycling", "Other Sports", "Obstacle",
    "Water Related", "Triathlon", "Multi-Discipline", "Marathon", "Adrenaline",
)
CLUBS = (
    "Inner Wheel Clubs", "Lions", "Other Community Groups", "Other Professional Groups",
    "Other Women's Groups", "Rotary", "Soroptimist Clubs",
)

HIGH_VALUE_PRODUCTS = [
    rule(73, audience=HIGH_VALUE, product=is_("Direct Solicited Donations")),
    rule(72, audience=HIGH_VALUE, product=is_("Donor Reporting")),
]
HIGH_VALUE_REST = [rule(71, audience=HIGH_VALUE)]

RECRUITMENT_PRODUCTS = [
    rule(52, descriptor=RECRUITMENT, product=is_("Regular Gifts - Doordrop")),
    rule(63, descriptor=RECRUITMENT, product=is_(
        "Regular Gifts - Hothouse", "Regular Gifts - BRTV",
        "Regular Gifts - Hothouse BRTV", "Regular Gifts - Hothouse Door Drop")),
    rule(35, descriptor=RECRUITMENT, product=is_("Regular Gifts - Inserts")),
    rule(62, descriptor=RECRUITMENT, product=is_("Regular Gifts - Word of Mouth")),
]

DEFAULT_GROUP = [rule("default_group", rule_number=number(0))]


def _digital(rule_number: int, otherwise: int, social: bool = True) -> list[Rule]:
    """Paid search and social advertising leave a numbered rule before its own group."""
    arms = [rule(45, rule_number=number(rule_number), product=is_("PPC"))]
    if social:
        arms.append(rule(61, rule_number=number(rule_number), product=is_("Social Media Advertising")))
    return [*arms, rule(otherwise, rule_number=number(rule_number))]


TRUSTS = [rule(75, rule_number=number(4, 21), audience=is_("Small Trusts")), *_digital(4, 39), *_digital(21, 39)]
TEXT_TV = [rule(55, rule_number=number(7), product=is_("PSMS - DRTV")), rule(33, rule_number=number(7))]
UPGRADE_SPLIT = [
    rule(79, rule_number=number(23), product=UPGRADES, audience=HIGH_VALUE, package_category=PHONE),
    rule(78, rule_number=number(23), product=UPGRADES, audience=HIGH_VALUE, package_category=MAIL),
    rule(37, rule_number=number(23), product=UPGRADES, appeal_type=is_("Welcome"), package_category=PHONE),
    rule(64, rule_number=number(23), product=UPGRADES, appeal_type=is_("Welcome"), package_category=MAIL),
    rule(65, rule_number=number(23), product=UPGRADES, appeal_type=is_("Non-Welcome upgrade appeal"), package_category=PHONE),
    rule(66, rule_number=number(23), product=UPGRADES, appeal_type=is_("Non-Welcome upgrade appeal"), package_category=MAIL),
]
TAIL = [
    rule(50, rule_number=number(23)),
    *_digital(20, 50),
    rule(50, rule_number=number(22)),
    rule(49, rule_number=number(24)),
    rule(53, rule_number=number(26)),
]


def _regular_body(social_in_rule_six: bool = True, wide: bool = False) -> list[Rule]:
    high_value_teams = [rule(72, rule_number=number(17, 18, 19))] if wide else []
    return [
        *TRUSTS,
        rule(51, rule_number=number(5)),
        *_digital(6, 54, social=social_in_rule_six),
        *TEXT_TV,
        *high_value_teams,
        *UPGRADE_SPLIT,
        *TAIL,
    ]


REGULAR_RULES = {
    "NEW": [*HIGH_VALUE_PRODUCTS, *RECRUITMENT_PRODUCTS, *DEFAULT_GROUP, *_regular_body()],
    # Changes look at rule 0 before the recruitment products.
    "CHANGE": [*HIGH_VALUE_PRODUCTS, *DEFAULT_GROUP, *RECRUITMENT_PRODUCTS, *_regular_body()],
    # Cancellations have no social advertising arm under rule 6.
    "CANCEL": [*HIGH_VALUE_PRODUCTS, *RECRUITMENT_PRODUCTS, *DEFAULT_GROUP, *_regular_body(social_in_rule_six=False)],
    "WIDE": [*HIGH_VALUE_PRODUCTS, *HIGH_VALUE_REST, *RECRUITMENT_PRODUCTS, *DEFAULT_GROUP, *_regular_body(wide=True)],
}

# Descriptors missing from the rule table drop out of changes and cancellations only.
REGULAR_JOIN = {"NEW": "left", "CHANGE": "inner", "CANCEL": "inner", "WIDE": "left"}

CASH_RULES = [
    *HIGH_VALUE_PRODUCTS,
    *HIGH_VALUE_REST,
    rule(58, rolling_sms=holds()),
    rule(84, descriptor=both(EVENT_OR_COMMUNITY, has(*ACTIVE_WORDS)), audience=PEER),
    rule(86, descriptor=both(EVENT_OR_COMMUNITY, has("In Celebration")), audience=PEER),
    rule(87, descriptor=EVENT_OR_COMMUNITY, audience=PEER),
    rule(26, product=is_("Glastonbury Festival")),
    rule(88, product=is_("WaterAid 200", "Tough Sh!t")),
    rule(25, descriptor=both(EVENT_OR_COMMUNITY, has(*ACTIVE_WORDS))),
    rule(27, descriptor=begins("Event")),
    rule(28, audience=is_("Faith Groups")),
    rule(29, audience=is_("Schools")),
    rule(89, audience=is_("Local Groups")),
    rule(91, audience=is_("Choir Groups")),
    rule(92, audience=is_("Youth Groups")),
    rule(93, audience=is_("Universities")),
    rule(30, audience=is_(*CLUBS)),
    *RECRUITMENT_PRODUCTS,
    *DEFAULT_GROUP,
    *TRUSTS,
    rule(46, rule_number=number(5), gift_code=has("Wahoo")),
    rule(46, rule_number=number(5), product=is_("Wahoo Gifting")),
    rule(51, rule_number=number(5)),
    *_digital(6, 53),
    *TEXT_TV,
    *_digital(20, 50),
    rule(50, rule_number=number(22)),
    rule(50, rule_number=number(23)),
    rule(49, rule_number=number(24)),
    rule(53, rule_number=number(26)),
]

KNOWN_INCOME_TEAMS = (
    "Supporter Recruitment Team", "NULL", "Direct Marketing Team", "Sdev", "SRec",
    "Supporter Development & Retention Team", "Digital Marketing Team", "Community Team",
    "Comm - Not Categorised", "Events Team",
)
STARTED_NOW = is_("Gift started during this financial year")
STARTED_BEFORE = is_("Gift started before this financial year")
AMENDED_NOW = is_("Gift amended during this financial year")
DEBIT, NOT_DEBIT = is_("Direct Debit"), is_not("Direct Debit")

INCOME_RULES = [
    rule(69, gift_code=is_("SMS")),
    rule(998, descriptor=begins_with_none(*KNOWN_INCOME_TEAMS)),
    rule(31, descriptor=both(begins("Community Team", "Comm - Not Categorised"), lacks("High Value"))),
    rule(27, descriptor=both(begins("Events Team"), lacks("High Value"))),
    rule(82, descriptor=has("Upgrade"), payment_type=DEBIT, started=STARTED_NOW),
    rule(82, descriptor=has("Upgrade"), payment_type=DEBIT, amended=AMENDED_NOW),
    rule(83, descriptor=has("Upgrade"), payment_type=NOT_DEBIT, started=STARTED_NOW),
    rule(83, descriptor=has("Upgrade"), payment_type=NOT_DEBIT, amended=AMENDED_NOW),
    rule(68, descriptor=has("High Value"), payment_type=DEBIT),
    rule(76, descriptor=has("High Value"), payment_type=NOT_DEBIT),
    rule(68, started=STARTED_BEFORE, payment_type=DEBIT),
    rule(76, started=STARTED_BEFORE, payment_type=NOT_DEBIT),
    rule(80, started=STARTED_NOW, payment_type=DEBIT),
    rule(81, started=STARTED_NOW, payment_type=NOT_DEBIT),
]

PEER_EVENT = "Peer to peer event"
ACTIVE_TYPES = tuple(
    f"FR Event - {kind}"
    for kind in (
        "Adrenaline", "Climbing", "Cycling", "Half Marathon", "Marathon", "Multi-discipline Event",
        "Obstacle", "Other Running", "Walking", "Water Related",
    )
)
SOCIAL_TYPES = ("FR Event - Music/Dancing", "FR Event - Dinner", "FR Event - Food and Drink")

EVENT_RULES = [
    rule(84, event_type=is_(PEER_EVENT), action_type=is_(*ACTIVE_TYPES)),
    rule(85, event_type=is_(PEER_EVENT), action_type=is_(*SOCIAL_TYPES)),
    rule(86, event_type=is_(PEER_EVENT), action_type=is_("FR Event - Celebration")),
    rule(87, event_type=is_(PEER_EVENT)),
    rule(88, event_type=is_("WaterAid Mass Participation Event")),
    rule(25, action_type=is_(*ACTIVE_TYPES)),
]
EVENT_DEFAULT, EVENT_PARENT, PEER_PARENT = 27, 13, 24

PACK_RULES = [rule(29, constituent_type=is_("School")), rule(28, constituent_type=is_("Faith Group"))]
PACK_DEFAULT, PACK_PARENT = 31, 14

LEAF_LEVEL = 8


def _with_rule_numbers(df: DataFrame, descriptors: DataFrame, how: str) -> DataFrame:
    known = descriptors.select(
        text.fold(F.col("descriptor")).alias("_known"), F.col("rule_number"), F.col("default_group")
    )
    return df.join(known, text.fold(F.col("descriptor")) == F.col("_known"), how).drop("_known")


def classify_regular(variant: str, df: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Add ``group_id`` for new gifts, changes, cancellations, or the wide history."""
    ruled = _with_rule_numbers(df, descriptors, REGULAR_JOIN[variant])
    return first_match(ruled, REGULAR_RULES[variant], UNGROUPED).drop("rule_number", "default_group")


def classify_cash(df: DataFrame, descriptors: DataFrame) -> DataFrame:
    ruled = _with_rule_numbers(df, descriptors, "left")
    return first_match(ruled, CASH_RULES, UNGROUPED).drop("rule_number", "default_group")


def classify_rg_income(df: DataFrame) -> DataFrame:
    """Received regular-giving income; rows that meet no rule get a NULL group."""
    return first_match(df, INCOME_RULES, None)


def classify_event(df: DataFrame) -> DataFrame:
    parent = F.when(text.same(F.col("event_type"), PEER_EVENT), PEER_PARENT).otherwise(EVENT_PARENT)
    return (
        first_match(df, EVENT_RULES, EVENT_DEFAULT)
        .withColumn("forms_part_of", parent.cast("int"))
        .withColumn("level", F.lit(LEAF_LEVEL))
    )


def classify_pack(df: DataFrame) -> DataFrame:
    return (
        first_match(df, PACK_RULES, PACK_DEFAULT)
        .withColumn("forms_part_of", F.lit(PACK_PARENT))
        .withColumn("level", F.lit(LEAF_LEVEL))
    )
