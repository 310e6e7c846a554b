"""Regular-gift history: change rows, their descriptors, and the movements they make.

Fact-to-fact joins are on the gift and on the constituent only. Everything else is a
dimension: chains of dimension joins are flattened first, dimension against dimension,
so that each fact row meets every dimension once. No broadcast is forced here, because
appeals, packages and constituents grow; Spark broadcasts them by measured size and
otherwise sort-merges, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from givetide.functions import months as m
from givetide.functions import text

# Team code -> descriptor. They must match the warehouse's labels.
TEAM_LABELS = {
    "CF/IS": "SDev - Appeal Unknown",
    "CF/IS/AU": "SDev - Autumn Cash Appeal",
    "CF/IS/CA": "SDev - Feedback Activity",
    "CF/IS/CC": "SRec - Water Company Customer Campaign",
    "CF/IS/CV": "SDev - Conversion to Committed Giving",
    "CF/IS/DM": "SRec - Cold Direct Mail",
    "CF/IS/DR": "SDev - Doordrop Activity",
    "CF/IS/EA": "SDev - Other Cash Appeals",
    "CF/IS/GA": "SDev - Gift Aid Activity",
    "CF/IS/HV": "SDev - High Value Supporter Activity - Cash & RG Ask",
    "CF/IS/IN": "SRec - Inserts",
    "CF/IS/OA": "SDev - Supporter Magazine Oasis",
    "CF/IS/PH": "SRec - Cold Telephone",
    "CF/IS/PR": "SRec - Press Advertisements",
    "CF/IS/RV": "SDev - Reactivation Activity",
    "CF/IS/SH": "SDev - Shop Online & Offline",
    "CF/IS/SP": "SDev - Spring Cash Appeal",
    "CF/IS/SU": "SDev - Summer Cash Appeal",
    "CF/IS/TV": "SRec - Direct Response TV Ad",
    "CF/IS/UP": "SDev - Upgrade Activity",
    "CF/IS/WB": "SRec - Online Not Categorised",
    "CF/IS/WI": "SDev - Winter Cash Appeal",
    "CF/MD": "MajD - Not Categorised",
    "NF": "NatF - Not Categorised",
    "NF/CM": "Comm - Not Categorised",
    "NF/CR": "Corp - Not Categorised",
    "NF/PG": "Corp - Payroll Giving Appeals",
    "NF/RE": "WIP - Not Categorised",
    "PP": "SDev - Campaigning Activity",
}

REGULAR_GIFT = 30
NO_GROUP = 999


def descriptor(team: Column, campaign: Column) -> Column:
    """Label of a known team code, else ``code - campaign`` (NULL if either is NULL)."""
    labels = F.expr("map(" + ", ".join(f"'{code.lower()}', '{label}'" for code, label in TEAM_LABELS.items()) + ")")
    return F.coalesce(F.try_element_at(labels, text.fold(team)), F.concat(team, F.lit(" - "), campaign))


def upgrade_appeals(appeals: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Identifiers of the appeals that count as upgrade activity."""
    ident, descr = F.col("appeal_identifier"), F.col("appeal_description")
    by_code = (
        text.contains(ident, "/u")
        & ~text.starts(ident, "RA/")
        & ~text.contains(descr, "Unallocated")
        & ~text.contains(descr, "Unicef")
    )
    names = campaigns.select("campaign_id", F.col("campaign_description").alias("_campaign"))
    return (
        appeals.join(names, "campaign_id")
        .filter(by_code | text.same(F.col("_campaign"), "Upgrade Activity"))
        .select("appeal_identifier")
        .distinct()
    )


def rolling_sms_appeals(packages: DataFrame) -> DataFrame:
    """Appeal identifiers, taken from SMS packages, that count as rolling SMS."""
    ident = F.col("package_identifier")
    return (
        packages.filter(text.same(F.col("package_category"), "SMS") & text.one_of(F.substring(ident, 4, 3), ["CAC", "CAD"]))
        .select(F.substring(ident, 1, 6).alias("rolling_sms_appeal"))
        .distinct()
    )


def appeal_type(identifier: Column, listed: Column) -> Column:
    """Welcome, non-welcome upgrade, or other; ``listed`` says it is an upgrade appeal."""
    upgrade = "Non-Welcome upgrade appeal"
    return (
        F.when(text.same(F.substring(identifier, 3, 4), "/UPR"), "Welcome")
        .when(text.same(F.substring(identifier, 3, 3), "/UP"), upgrade)
        .when(listed, upgrade)
        .otherwise("Other")
    )


def appeal_types(appeals: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Distinct appeal identifiers with their type; a dimension, built once."""
    listed = upgrade_appeals(appeals, campaigns).select(text.fold(F.col("appeal_identifier")).alias("_key"), F.lit(True).alias("_listed"))
    return (
        appeals.select("appeal_identifier")
        .filter("appeal_identifier is not null")
        .distinct()
        .join(listed.dropDuplicates(["_key"]), text.fold(F.col("appeal_identifier")) == F.col("_key"), "left")
        .select("appeal_identifier", appeal_type(F.col("appeal_identifier"), F.coalesce("_listed", F.lit(False))).alias("appeal_type"))
    )


def _appeal_descriptors(appeals: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Appeal key -> identifier, descriptor and default group.

    The descriptor is read from every appeal that shares the identifier, as the history
    does; appeals with the same identifier therefore multiply its rows.
    """
    same_identifier = appeals.select(
        text.fold(F.col("appeal_identifier")).alias("_k"),
        descriptor(F.col("appeal_category"), F.col("campaign_description")).alias("descriptor"),
    )
    known = descriptors.select(text.fold(F.col("descriptor")).alias("_d"), F.col("default_group"))
    return (
        appeals.select("appeal_id", "appeal_identifier", "appeal_description")
        .join(same_identifier, text.fold(F.col("appeal_identifier")) == F.col("_k"), "left")
        .join(known, text.fold(F.col("descriptor")) == F.col("_d"), "left")
        .select("appeal_id", "appeal_identifier", "appeal_description", "descriptor", "default_group")
    )


CORE_GIFT_COLUMNS = ["payment_type_id", "audience_id", "gift_status_id", "gift_system_id"]


def regular_gift_changes(w, persons_first: bool = False) -> DataFrame:
    """Changes of regular gifts with their person and the gift's own columns.

    This is the history without its dimensions: enough for everything that follows
    amounts through time, at the cost of the two fact joins only. With ``persons_first`` the second of their shuffles
    doesn't carry the gift's columns, but leaves each gift's changes in one task: for those that write them next.
    """
    gifts = w.regular_gift.select("gift_id", "gift_code_id", *CORE_GIFT_COLUMNS)
    persons = w.constituent.select("constituent_key", "constituent_id")
    if persons_first:
        return w.gift_change.join(persons, "constituent_key").join(gifts, "gift_id")
    return w.gift_change.join(gifts, "gift_id").join(persons, "constituent_key")


def rg_history(w, carry: bool = False) -> DataFrame:
    """Every change of every regular gift, with previous amounts, descriptor and group.

    ``carry=True`` keeps the gift's own columns (payment type, audience, status, system
    id), so that later steps need not join the gift fact again.
    """
    packages = w.package.select("package_id", "package_identifier", "package_description")
    campaigns = w.campaign.select("campaign_id", "campaign_identifier", "campaign_description")
    appeals = w.dimension("appeal_descriptors", lambda: _appeal_descriptors(w.appeal, w.known_descriptor))
    now = w.instalment_frequency.select("frequency_id", "instalments_per_year")
    was = w.instalment_frequency.select(
        F.col("frequency_id").alias("previous_frequency_id"), F.col("instalments_per_year").alias("_previous")
    )
    # The unknown code -1 has no row in the code table that may be used.
    codes = w.gift_code.filter("gift_code_id > -1").select("gift_code_id", F.col("gift_code_description").alias("gift_code"))
    return (
        regular_gift_changes(w)
        .join(now, "frequency_id", "left")
        .join(was, "previous_frequency_id", "left")
        .join(packages, "package_id", "left")
        .join(appeals, "appeal_id", "left")
        .join(campaigns, "campaign_id", "left")
        .join(codes, "gift_code_id", "left")
        .selectExpr("*", "if(sequence = 1, null, _previous) as _before", "annual_amount - change_annual_amount as _annual_before")
        .selectExpr("*", "try_divide(_annual_before, _before) as _instalment_before")
        .selectExpr(
            "constituent_id", "gift_id", "change_id", "sequence", "is_original", "appeal_description", "appeal_identifier",
            "campaign_identifier", "campaign_description", "package_identifier", "package_description", "change_date_key",
            "amount", "annual_amount", "change_amount", "change_annual_amount", "instalments_per_year",
            "_before as previous_instalments_per_year",
            "if(_before is null or _before = instalments_per_year, 'No', 'Yes') as frequency_changed",
            "_annual_before as previous_annual_amount",
            "_instalment_before as previous_instalment_amount",
            "coalesce(amount - _instalment_before, change_amount) as adjusted_change_amount",
            "descriptor",
            f"cast(coalesce(default_group, {NO_GROUP}) as int) as dash_group",
            "gift_code",
            *(CORE_GIFT_COLUMNS if carry else []),
        )
    )


def _appeals_by_identifier(w) -> DataFrame:
    """Product and type of every appeal, keyed by its case-blind identifier."""

    def build() -> DataFrame:
        kinds = appeal_types(w.appeal, w.campaign).select(F.col("appeal_identifier").alias("_kind_of"), "appeal_type")
        return w.appeal.join(kinds, F.col("appeal_identifier") == F.col("_kind_of")).select(
            text.fold(F.col("appeal_identifier")).alias("_appeal"), "product", "appeal_type"
        )

    return w.dimension("appeals_by_identifier", build)


def _appeal_profile(w) -> DataFrame:
    """Appeal key -> descriptor, product and type of the appeals sharing its identifier.

    Descriptor and product are looked up by identifier one after the other, so n appeals
    with one identifier make n x n rows, as they do in the history itself.
    """

    def build() -> DataFrame:
        described = _appeal_descriptors(w.appeal, w.known_descriptor)
        return described.join(
            _appeals_by_identifier(w), text.fold(F.col("appeal_identifier")) == F.col("_appeal"), "left"
        ).select(
            "appeal_id",
            "appeal_identifier",
            "descriptor",
            "product",
            F.coalesce("appeal_type", F.lit("Other")).alias("appeal_type"),
            F.col("_appeal").isNotNull().alias("has_appeal"),
        )

    return w.dimension("appeal_profile", build)


def _package_categories(w, shared: str) -> DataFrame:
    """Package key -> category of every package that shares its description or identifier."""

    def build() -> DataFrame:
        others = w.package.select(text.fold(F.col(shared)).alias("_shared"), "package_category")
        return w.package.select("package_id", shared).join(others, text.fold(F.col(shared)) == F.col("_shared"), "left").select(
            "package_id", "package_category"
        )

    return w.dimension(f"package_category_by_{shared}", build)


def _counted_categories(w, shared: str) -> DataFrame:
    """The rows of ``_package_categories``, each once with the number of its copies, without building them.

    Packages that share a name are counted by category before they meet, so n of them make n rows for each category
    and not n x n.
    """

    def build() -> DataFrame:
        others = w.package.groupBy(text.fold(F.col(shared)).alias("_shared"), "package_category").agg(F.count(F.lit(1)).alias("_n"))
        mine = w.package.groupBy("package_id", text.fold(F.col(shared)).alias("_own")).agg(F.count(F.lit(1)).alias("_m"))
        copies = F.sum(F.col("_m") * F.coalesce("_n", F.lit(1))).alias("copies")
        return mine.join(others, F.col("_own") == F.col("_shared"), "left").groupBy("package_id", "package_category").agg(copies)

    return w.dimension(f"counted_category_by_{shared}", build)


def rule_history(w, packages_by: str = "package_description", counted: bool = False, persons_first: bool = False) -> DataFrame:
    """The columns that group rules and movements need, with few joins per change.

    Dimension chains are flattened to one join on an integer key each. Narrow rows and
    few joins also keep the generated code small enough to be compiled.

    Packages that share a name repeat each of their changes. With ``counted`` a change has one row for each category
    among them, and ``copies`` says how often it stands, so rows don't grow with the square of a name's packages.
    """
    categories = (_counted_categories if counted else _package_categories)(w, packages_by)
    copies = [F.coalesce("copies", F.lit(1)).alias("copies")] if counted else []
    codes = w.gift_code.filter("gift_code_id > -1").select("gift_code_id", F.col("gift_code_description").alias("gift_code"))
    return (
        regular_gift_changes(w, persons_first)
        .join(_appeal_profile(w), "appeal_id", "left")
        .join(categories, "package_id", "left")
        .join(w.audience.select("audience_id", "audience"), "audience_id", "left")
        .join(codes, "gift_code_id", "left")
        .select(
            "constituent_id", "gift_id", "sequence", "is_original", "change_date_key", "change_annual_amount",
            "payment_type_id", "gift_status_id", "gift_system_id", "has_appeal", "appeal_identifier", "descriptor",
            "product", F.coalesce("appeal_type", F.lit("Other")).alias("appeal_type"), "package_category", "audience",
            "gift_code", *copies,
        )
    )


FACT_COLUMNS = ["month", "appeal_type", "appeal_identifier", "package_category", "product", "audience", "descriptor", "gift_code"]


def _movement(rows: DataFrame, value: str) -> DataFrame:
    """Changes without a known appeal drop out of every movement; counted changes stay counted."""
    copies = [c for c in ("copies",) if c in rows.columns]
    return rows.filter("has_appeal").selectExpr("gift_id", f"{value} as value", *FACT_COLUMNS, *copies)


def _days(w) -> DataFrame:
    return w.calendar.select(F.col("date_key").alias("change_date_key"), "month")


def new_gift_facts(w, changes: DataFrame) -> DataFrame:
    """Original gifts; a date outside the calendar leaves the month NULL."""
    return _movement(changes.filter("is_original = 1").join(_days(w), "change_date_key", "left"), "change_annual_amount")


def amendment_facts(w, changes: DataFrame) -> DataFrame:
    """Later changes that moved the annual value."""
    moved = changes.filter("is_original = 0 and change_annual_amount <> 0")
    return _movement(moved.join(_days(w), "change_date_key"), "change_annual_amount")


# Status keys that make a regular gift "cancelled", and the status texts
# whose date is read.
CANCELLED_STATUS_IDS = [3, 5]
CANCELLED_TEXTS = ["Terminated", "Canceled"]


def cancellation_facts(w, changes: DataFrame) -> DataFrame:
    """All component rows of cancelled gifts, negated, in the month of the status date.

    A cancelled gift without a date has a NULL month.
    """
    dated = (
        w.gift_status_date.filter(text.one_of(F.col("status"), CANCELLED_TEXTS))
        .join(w.calendar.select(F.col("date").alias("status_date"), "month"), "status_date", "left")
        .select("gift_system_id", "month")
    )
    ended = changes.filter(F.col("gift_status_id").isin(CANCELLED_STATUS_IDS))
    return _movement(ended.join(dated, "gift_system_id", "left"), "-change_annual_amount")


# Status texts of gifts whose end is attributed to an appeal.
ATTRIBUTED_TEXTS = ["Cancelled", "Terminated"]


def last_appeal_attribution(w, prefixes: list[str]) -> DataFrame:
    """Annual value of cancelled gifts by the last appeal that the person got before, per send and per person sent to.

    Only the last cancelled gift of a person counts; among gifts ended on one day the one with the greatest id. The
    last appeal is the latest with an earlier date; among appeals of one day the greatest identifier. So one
    aggregate per person and one per person and send suffice, and no person's gifts meet all of its sends. Appeals
    are kept whose identifier begins with one of ``prefixes``.
    """
    ended = (
        w.gift_status_date.filter(text.one_of(F.col("status"), ATTRIBUTED_TEXTS) & F.col("status_date").isNotNull())
        .join(w.regular_gift.select("gift_system_id", "gift_id", "constituent_key"), "gift_system_id")
        .join(w.constituent.select("constituent_key", "constituent_id"), "constituent_key")
        .join(w.rg_fact.select("gift_id", "annual_amount"), "gift_id")
        .groupBy("constituent_id")
        .agg(F.max(F.struct("status_date", "gift_id", "annual_amount")).alias("ended"))
    )
    last = (
        w.appeal_send.join(ended, "constituent_id")
        .filter("appeal_date < ended.status_date")
        .groupBy("constituent_id")
        .agg(F.max_by("appeal_identifier", F.struct("appeal_date", "appeal_identifier")).alias("appeal_identifier"), F.first("ended.annual_amount").alias("value"))
        .filter(text.starts(F.col("appeal_identifier"), *prefixes))
        .groupBy(text.fold(F.col("appeal_identifier")).alias("_appeal"))
        .agg(F.min("appeal_identifier").alias("appeal_identifier"), F.count(F.lit(1)).alias("people"), F.sum("value").alias("cancelled_value"))
    )
    sent = (
        w.appeal_send.groupBy(text.fold(F.col("appeal_identifier")).alias("_appeal"), "constituent_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_appeal")
        .agg(F.sum("n").alias("sends"), F.count("constituent_id").alias("people_sent"))
    )
    described = w.appeal.groupBy(text.fold(F.col("appeal_identifier")).alias("_appeal")).agg(F.min("appeal_description").alias("appeal_description"))
    return (
        last.join(sent, "_appeal", "left")
        .join(described, "_appeal", "left")
        .select(
            "appeal_identifier", "appeal_description", "people", "cancelled_value", "sends", "people_sent",
            F.expr("try_divide(cancelled_value, sends)").alias("value_per_send"),
            F.expr("try_divide(cancelled_value, people_sent)").alias("value_per_person_sent"),
        )
    )


def grouped_changes(w) -> DataFrame:
    """Every change with its month and group under the wide rules, narrow."""
    from givetide.operators.groups import classify_regular

    dated = rule_history(w, "package_identifier", persons_first=True).join(_days(w), "change_date_key")
    return classify_regular("WIDE", dated, w.known_descriptor).select(
        "constituent_id", "gift_id", "month", "group_id", "sequence", "change_annual_amount", "payment_type_id"
    )


def widened_history(w, history: DataFrame) -> DataFrame:
    """History plus product, package category, audience, appeal type, month and group."""
    from givetide.operators.groups import classify_regular

    by_identifier = w.package.filter("package_identifier is not null").select(
        text.fold(F.col("package_identifier")).alias("_package"), "package_category"
    )
    groups = w.group.select(F.col("group_id").alias("_group"), "forms_part_of", "level", F.col("description").alias("group_description"))
    wide = (
        history.join(_days(w), "change_date_key")
        .join(_appeals_by_identifier(w), text.fold(F.col("appeal_identifier")) == F.col("_appeal"), "left")
        .join(by_identifier, text.fold(F.col("package_identifier")) == F.col("_package"), "left")
        .join(w.audience.select("audience_id", "audience"), "audience_id", "left")
        .withColumn("appeal_type", F.coalesce("appeal_type", F.lit("Other")))
    )
    classified = classify_regular("WIDE", wide, w.known_descriptor)
    return classified.join(groups, F.col("group_id") == F.col("_group"), "left").drop("_group", "_appeal", "_package")
