"""Play the warehouse's roles with order tables.

The order tables have customers who order and lines that ship; here a customer is a
supporter, an order a regular gift, a line both a change of that gift and a payment, a
part line the appeal, a supplier the package and an event an action. Every fact row is
kept. Attributes the order tables lack are computed from columns of the same row, so
each table grows with its source.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from givetide.operators.calendar import calendar, month_spine
from givetide.operators.groups import ACTIVE_TYPES, CLUBS
from givetide.operators.history import TEAM_LABELS, descriptor
from givetide.operators.numbering import number_groups
from givetide.sources.warehouse import Warehouse, bytes_at, guard, settle

AS_OF = dt.date(2001, 9, 15)

# A gift's id leaves room for the ids of its lines; a longer order raises an error.
LINES_PER_ORDER = 10_000_000
NEW_PERSON_ID = 1_000_000
SYSTEM_ID = 500
EVENT_DAYS_BACK = 8140

CAMPAIGNS = [
    "Upgrade Activity", "Running", "Walking", "Climbing", "Cycling", "Other Sports", "Obstacle", "Water Related",
    "Triathlon", "Multi-Discipline", "Marathon", "Adrenaline", "In Celebration", "High Value Dinner", "General",
    "Spring Letter", "Autumn Letter", "UPGRADE ACTIVITY", "Legacy", "Door to Door", "Private Sites", "Radio",
    "half marathon", "Choirs", "Carols",
]
TEAMS = [
    "Events Team", "Community Team", "events team", "Event Partners", "Comm - Not Categorised", "Supporter Recruitment Team",
    "CF/IS", "CF/IS/DM", "CF/IS/IN", "cf/is/up", "CF/IS/HV", "CF/MD", "NF", "NF/CM", "NF/CR", "PP", "Digital Marketing Team",
    "Direct Marketing Team", "Comms", "Events Team", "Community Team", "CF/IS/TV", "CF/IS/WB", "Trusts", "Corporate",
]
CATEGORIES = [*TEAM_LABELS, "Events Team", "Community Team", "Supporter Recruitment Team", "Digital Marketing Team", "Trusts"]
PRODUCTS = [
    "Direct Solicited Donations", "Donor Reporting", "Regular Gifts - Doordrop", "Regular Gifts - Hothouse",
    "Regular Gifts - BRTV", "Regular Gifts - Hothouse BRTV", "Regular Gifts - Hothouse Door Drop", "Regular Gifts - Inserts",
    "Regular Gifts - Word of Mouth", "PPC", "Social Media Advertising", "PSMS - DRTV",
    "Regular Gifts - Upgrade and Reactivation", "Glastonbury Festival", "WaterAid 200", "Tough Sh!t", "Wahoo Gifting",
    "regular gifts - upgrade and reactivation", "General",
]
AUDIENCES = [
    "High Value Supporter", "Small Trusts", "Peer to Peer Fundraiser", "Faith Groups", "Schools", "Local Groups",
    "Choir Groups", "Youth Groups", "Universities", *CLUBS, "High Value Supporter", "peer to peer fundraiser",
    "General Public", "General Public", "Peer to Peer Fundraiser", "Cold", "Warm", "Lapsed", "Enquirer",
]
APPEAL_KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
APPEAL_CODES = ["UPR", "UP1", "CAC", "CAD", "u77", "EV1"]
PACKAGE_CODES = ["CAC", "CAD", "TEL", "DMA", "DMR"]
PACKAGE_CATEGORIES = ["SMS", "SMS", "Telephone", "Direct Mail", "Direct Mail Reminder"]
GIFT_CODES = ["Website Direct Debit", "SMS", "Standard", "Wahoo Catalogue", "Telephone"]
PAYMENT_TYPES = ["Direct Debit", "Standing Order", "Credit Card", "Cheque", "Payroll"]
GIFT_STATUSES = ["Active", "Held", "Terminated", "Completed", "Canceled"]
INSTALMENTS = [12, 4, 2, 1, 6]
ACTION_TYPES = [
    *ACTIVE_TYPES, "FR Event - Music/Dancing", "FR Event - Dinner", "FR Event - Food and Drink", "FR Event - Celebration",
    "FR Event - In Memory", "fr event - cycling", "FR Pack - Schools", "FR Pack - Faith", "FR Pack - Community",
    "FR Pack - General", "Meeting", "FR Pack - Talks", "FR Event - Just Water", "FR Event - Marathon", "FR Pack - Events",
]
ACTION_STATUSES = {"view": "Participating", "click": "Accepted", "purchase": "Sent", "error": "Declined", "signup": "Pending Approval"}
RULE_NUMBERS = [0, 4, 5, 6, 7, 20, 21, 22, 23, 24, 26, 17, 18, 19, 23, 6]
UNRULED_LENGTHS = [19, 35]
METRIC_TYPES = [
    "AnnualValueOfNewRegularGifts", "AnnualValueOfChangesToRegularGifts", "AnnualValueCancelledThisMonth",
    "ValueOfCashGifts", "ActualReceivedRGIncome", "SignUpsDuringMonth", "ReceivedPackDuringMonth",
]
TARGET_GROUPS = [25, 27, 28, 31, 33, 39, 45, 50, 51, 53, 54, 61, 68, 72, 73, 76, 84, 88]
UNLISTED_GROUP = 71


def literals(values: list) -> str:
    """SQL array of literals."""
    return "array(" + ", ".join(str(v) if isinstance(v, int) else f"{v!r}" for v in values) + ")"


def pick(values: list, index: str) -> str:
    """SQL for the element of a literal list at a zero-based index; NULL when out of range."""
    return f"get({literals(values)}, cast({index} as int))"


def money(sql: str) -> str:
    return f"cast(cast({sql} as decimal(19,2)) as decimal(19,4))"


def day_key(day: str) -> str:
    return f"year({day}) * 10000 + month({day}) * 100 + day({day})"


def month_key(day: str) -> str:
    return f"year({day}) * 100 + month({day})"


ORDER_GIFT = f"o_orderkey * {LINES_PER_ORDER}"
LINE_GIFT = f"l_orderkey * {LINES_PER_ORDER}"
LINE_APPEAL = "cast(l_quantity * 10 + l_linenumber as int)"
STATUS_ID = """case when o_orderstatus = 'O' then 1 when o_orderstatus = 'P' then 2
    when o_orderpriority = '1-URGENT' then 3 when o_orderpriority = '5-LOW' then 4 else 5 end"""
STATUS_DATE = "case when o_orderpriority <> '3-MEDIUM' then date_add(day, cast(floor(o_totalprice) % 900 as int)) end"
CODE_ID = "cast(substring(o_orderpriority, 1, 1) as int) - 2"
PAYMENT_TYPE_ID = "cast(floor(o_totalprice) % 5 as int) + 1"


# Schema of each file read so far, so that a footer is read once per session.
_SCHEMAS: dict[str, StructType] = {}


LINE_ORDER = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def numbered_lines(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """Lines with their sequence within the order, by ship date and then all columns; settled.

    ``counted`` has the order of every line and of every order that joins them.
    """
    days = lines.selectExpr("*", "to_date(l_shipdate) as ship_day")
    return number_groups(days, "l_orderkey", ["ship_day", *LINE_ORDER], counted, most=LINES_PER_ORDER - 1)


def warehouse_of(spark: SparkSession, directory: str, as_of: dt.date = AS_OF) -> Warehouse:
    """Warehouse roles over ``<directory>/<table>.parquet``."""
    guard(spark, sum(bytes_at(spark, f"{directory}/{name}.parquet") for name in ("orders", "lineitem")))

    @functools.cache
    def raw(name: str) -> DataFrame:
        path = f"{directory}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)

    def orders() -> DataFrame:
        return raw("orders").selectExpr("*", "to_date(o_orderdate) as day")

    def with_owners(rows: DataFrame) -> DataFrame:
        owners = raw("orders").selectExpr("o_orderkey as l_orderkey", "o_custkey", "true as has_order")
        return rows.join(owners, "l_orderkey", "left")

    def lines() -> DataFrame:
        """Numbered lines with the customer, NULL without an order; settled once, as several tables are made of them."""
        keys = raw("lineitem").select("l_orderkey").union(raw("orders").select("o_orderkey"))
        return warehouse.settled("lines", lambda: numbered_lines(with_owners(raw("lineitem")), keys))

    def cash(rows: DataFrame, *ids: str) -> DataFrame:
        return rows.filter("l_returnflag = 'N'").selectExpr(
            *ids,
            f"o_custkey + {NEW_PERSON_ID} as constituent_id",
            "to_date(l_shipdate) as gift_date",
            f"{money('l_extendedprice')} as gift_amount",
            "case when l_linenumber = 5 then 'No' else 'Yes' end as is_counted",
        )

    def owned_lines() -> DataFrame:
        return lines().filter("has_order")

    @functools.cache
    def days() -> DataFrame:
        """The calendar: whole fiscal years around every date that a fact has, and around ``as_of``."""
        spans = [
            # Targets lie a year after the orders, the gifts' last changes 200 days.
            orders().selectExpr(f"least(min(day), min({STATUS_DATE})) as first", f"greatest(add_months(max(day), 12), max({STATUS_DATE})) as last"),
            raw("lineitem").selectExpr("to_date(min(l_shipdate)) as first", "to_date(max(l_shipdate)) as last"),
            actions().selectExpr("date_sub(min(day), 30) as first", "max(day) as last"),
        ]
        span = spans[0]
        for other in spans[1:]:
            span = span.unionByName(other)
        first, last = span.selectExpr(f"least(min(first), date'{as_of}')", f"greatest(max(last), date'{as_of}')").first()
        first = dt.date(first.year - (first.month < 4), 4, 1)
        return calendar(spark, first, dt.date(last.year + (last.month > 3), 3, 31), as_of)

    @functools.cache
    def status_dates() -> DataFrame:
        return orders().selectExpr(
            f"""case when o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED' then -o_orderkey - 1
                else o_orderkey + {SYSTEM_ID} end as gift_system_id""",
            f"{pick(GIFT_STATUSES, f'{STATUS_ID} - 1')} as status",
            f"{STATUS_DATE} as status_date",
        )

    def regular_gifts() -> DataFrame:
        return orders().selectExpr(
            f"{ORDER_GIFT} as gift_id",
            f"o_orderkey + {SYSTEM_ID} as gift_system_id",
            "o_custkey as constituent_key",
            "30 as gift_type_id",
            f"{STATUS_ID} as gift_status_id",
            f"{CODE_ID} as gift_code_id",
            f"{PAYMENT_TYPE_ID} as payment_type_id",
            "cast(o_custkey % 25 as int) as audience_id",
            "cast(o_custkey % 25 as int) as team_id",
            "cast(null as int) as appeal_id",
            "cast(null as bigint) as package_id",
            "cast(null as int) as campaign_id",
            "day as gift_date",
            f"{day_key('day')} as gift_date_key",
            f"{day_key('date_add(day, 200)')} as changed_date_key",
            f"{money('o_totalprice')} as amount",
        )

    def gifts() -> DataFrame:
        payments = owned_lines().selectExpr(
            f"{LINE_GIFT} + sequence as gift_id",
            "cast(null as bigint) as gift_system_id",
            "o_custkey as constituent_key",
            "case when l_returnflag = 'N' then 1 else 31 end as gift_type_id",
            "4 as gift_status_id",
            "l_linenumber - 2 as gift_code_id",
            "1 as payment_type_id",
            "cast(l_suppkey % 25 as int) as audience_id",
            "cast(l_suppkey % 25 as int) as team_id",
            f"{LINE_APPEAL} as appeal_id",
            "l_suppkey as package_id",
            "cast(l_suppkey % 25 as int) as campaign_id",
            "ship_day as gift_date",
            f"{day_key('ship_day')} as gift_date_key",
            f"{day_key('ship_day')} as changed_date_key",
            f"{money('l_extendedprice')} as amount",
        )
        return regular_gifts().unionByName(payments)

    def changes() -> DataFrame:
        rate = "(cast(l_discount as decimal(4,2)) - cast(l_tax as decimal(4,2)))"
        price = "cast(l_extendedprice as decimal(19,2))"
        return owned_lines().selectExpr(
            f"{LINE_GIFT} + sequence as change_id",
            f"{LINE_GIFT} as gift_id",
            "o_custkey as constituent_key",
            "sequence",
            "case when sequence = 1 then 1 else 0 end as is_original",
            f"{day_key('ship_day')} as change_date_key",
            f"{money('l_extendedprice')} as amount",
            f"cast({price} * 12 as decimal(19,4)) as annual_amount",
            f"{money('l_quantity')} as change_amount",
            f"cast(case when sequence = 1 then {price} * 12 else {price} * {rate} end as decimal(19,4)) as change_annual_amount",
            "case when l_linenumber = 7 then -1 else l_linenumber % 5 end as frequency_id",
            "case when l_linestatus = 'O' then 0 else l_linenumber % 4 end as previous_frequency_id",
            "case when l_linenumber = 6 then -1 else l_suppkey end as package_id",
            f"{LINE_APPEAL} as appeal_id",
            "cast(l_suppkey % 25 as int) as campaign_id",
        )

    @functools.cache
    def appeals() -> DataFrame:
        place = "(p_size * 6 + kind)"
        return (
            raw("part")
            .groupBy("p_size", "p_type")
            .count()
            .selectExpr("p_size", f"cast(array_position({literals(APPEAL_KINDS)}, p_type) as int) as kind")
            .selectExpr(
                "p_size * 10 + kind as appeal_id",
                f"""concat(case when p_size >= 48 then 'RA' else lpad(cast(p_size as string), 2, '0') end, '/',
                    {pick(APPEAL_CODES, "kind - 1")}) as appeal_identifier""",
                "case when p_size = 9 then 'Unicef joint' when p_size = 8 then 'Unallocated' else 'Appeal' end as appeal_description",
                f"case when p_size <> 7 then {pick(CATEGORIES, f'{place} % {len(CATEGORIES)}')} end as appeal_category",
                f"{pick(PRODUCTS, f'{place} % {len(PRODUCTS)}')} as product",
                "p_size % 25 as campaign_id",
                f"{pick(CAMPAIGNS, 'p_size % 25')} as campaign_description",
            )
        )

    def appeal_attributes() -> DataFrame:
        audience = f"case when not endswith(appeal_identifier, 'EV1') then {pick(AUDIENCES, 'appeal_id % 25')} end"
        return (
            appeals()
            .selectExpr("appeal_id", f"stack(2, 'Product', product, 'Target Audience', {audience}) as (attribute_category, attribute_description)")
            .filter("attribute_description is not null")
        )

    def gift_attributes() -> DataFrame:
        return lines().selectExpr(
            f"{LINE_GIFT} + sequence as gift_id",
            "case when l_linestatus = 'F' then 'Target Audience' else 'Thank you' end as attribute_category",
            f"case when l_linenumber < 4 then {pick(AUDIENCES, 'l_suppkey % 25')} end as attribute_description",
        )

    def descriptors_of_appeals() -> DataFrame:
        return appeals().select("appeal_id", descriptor(F.col("appeal_category"), F.col("campaign_description")).alias("descriptor"))

    def known_descriptors() -> DataFrame:
        of_teams = (
            raw("nation")
            .selectExpr(f"{pick(TEAMS, 'n_nationkey')} as team", f"explode({literals(CAMPAIGNS)}) as campaign")
            .select(descriptor(F.col("team"), F.col("campaign")).alias("descriptor"))
        )
        return (
            of_teams.unionByName(descriptors_of_appeals().select("descriptor"))
            .groupBy(F.lower("descriptor").alias("_d"))
            .agg(F.min("descriptor").alias("descriptor"))
            .filter(f"not array_contains({literals(UNRULED_LENGTHS)}, length(descriptor))")
            .selectExpr(
                "descriptor",
                "40 + length(descriptor) % 20 as default_group",
                f"{pick(RULE_NUMBERS, f'length(descriptor) % {len(RULE_NUMBERS)}')} as rule_number",
            )
        )

    def from_nation(key: str, value: str, values: list) -> DataFrame:
        return raw("nation").selectExpr(f"n_nationkey as {key}", f"{pick(values, 'n_nationkey')} as {value}")

    def from_region(key: str, value: str, values: list, first: int = 0) -> DataFrame:
        return raw("region").selectExpr(f"r_regionkey + {first} as {key}", f"{pick(values, 'r_regionkey')} as {value}")

    def actions() -> DataFrame:
        return raw("events").selectExpr("*", f"date_sub(to_date(ts), cast({EVENT_DAYS_BACK} + user_id * 7 % 700 as int)) as day")

    def action_attributes() -> DataFrame:
        return (
            raw("events")
            .selectExpr(
                "event_id as action_id",
                """stack(4,
                    'Event Name', case when event_type <> 'click' then concat(if(event_id % 5 = 0, 'EVENT ', 'Event '), cast(user_id % 7 as string), if(event_id % 3 = 0, ' ', '')) end,
                    'Event Registration Type', case when user_id < 75 then 'Team' end,
                    'Event Category', case when user_id % 4 = 0 then 'Peer to peer event'
                        when user_id % 4 = 1 then 'WaterAid Mass Participation Event' end,
                    'Fundraising Platform Used', case when user_id >= 100 then 'Online page' end
                ) as (attribute_category, attribute_description)""",
            )
            .filter("attribute_description is not null or attribute_category = 'Event Name'")
        )

    def constituent_codes() -> DataFrame:
        return (
            raw("customer")
            .selectExpr(
                "c_custkey as constituent_key",
                """stack(3, case when c_nationkey < 5 then 'Schools' end,
                    case when c_nationkey > 2 and c_nationkey < 10 then 'Faith Groups' end,
                    case when c_nationkey > 6 then 'General' end) as constituent_code""",
            )
            .filter("constituent_code is not null")
        )

    def rg_income() -> DataFrame:
        owners = orders().selectExpr(
            "o_orderkey as l_orderkey",
            f"{pick(PAYMENT_TYPES, f'{PAYMENT_TYPE_ID} - 1')} as payment_type",
            """case when day < date'2001-04-01' then 'Gift started before this financial year'
                when o_orderpriority <> '5-LOW' then 'Gift started during this financial year' end as started""",
            f"{pick(GIFT_CODES, f'nullif({CODE_ID}, -1)')} as gift_code",
        )
        keys = ["month", "appeal_id", "payment_type", "started", "amended", "gift_code"]
        return (
            raw("lineitem")
            .filter("l_returnflag <> 'N'")
            .join(owners, "l_orderkey")
            .selectExpr(
                f"{month_key('l_shipdate')} as month",
                f"{LINE_APPEAL} as appeal_id",
                "payment_type",
                "started",
                "case when l_discount > 0.05 then 'Gift amended during this financial year' else 'Not amended' end as amended",
                "gift_code",
                f"{money('l_extendedprice')} as value",
            )
            .groupBy(*keys)
            .agg(F.sum("value").alias("value"))
            .join(descriptors_of_appeals(), "appeal_id", "left")
            .select("month", "descriptor", "payment_type", "started", "amended", "gift_code", "value")
        )

    @functools.cache
    def groups() -> DataFrame:
        """Groups 24 to 93 and 998, one of them unlisted, under the regions."""
        ids = [g for g in [*range(24, 94), 998] if g != UNLISTED_GROUP]
        return (
            raw("region")
            .selectExpr("cast(count(*) as int) as regions")
            .selectExpr("regions", f"explode({literals(ids)}) as group_id")
            .selectExpr("group_id", "concat('Group ', cast(group_id as string)) as description", "group_id % regions + 10 as forms_part_of", "8 as level")
        )

    def upper_groups() -> DataFrame:
        """The levels above the groups: one group a region, two halves, and the whole."""
        half = "cast(r_regionkey % 2 as int)"
        return (
            raw("region")
            .selectExpr(
                f"""stack(3,
                    cast(r_regionkey as int) + 10, 'Region ' || r_name, {half} + 2, 7,
                    {half} + 2, 'Half ' || cast({half} as string), 1, 6,
                    1, 'Whole', cast(null as int), 5) as (group_id, description, forms_part_of, level)"""
            )
            .distinct()
        )

    def targets() -> DataFrame:
        """Per type and group: a share of the orders one year earlier."""
        return (
            orders()
            .groupBy(F.expr(f"{month_key('day')} + 100").alias("month"))
            .agg(F.expr(f"sum({money('o_totalprice')})").alias("total"))
            .selectExpr("month", "total", f"explode({literals(METRIC_TYPES)}) as type")
            .selectExpr("month", "total", "type", f"explode({literals(TARGET_GROUPS)}) as group_id")
            # The hand-kept table spells some types otherwise.
            .selectExpr("month", "total", "group_id", "case group_id when 33 then upper(type) when 51 then type || '  ' else type end as type")
            .join(groups(), "group_id")
            .selectExpr(
                "type", "month", "group_id", "forms_part_of", "level", "description",
                "cast(case when group_id = 61 then 0 else total * group_id end as decimal(29,4)) as target",
            )
        )

    def nonfinancial_targets() -> DataFrame:
        return (
            orders()
            .groupBy(F.expr(month_key("day")).alias("month"))
            .count()
            .selectExpr(
                "month",
                "cast(count as decimal(19,4)) as target_value",
                """stack(6,
                    'Community and Events', 'Packs', 'Count of pack requests made in month', 'Pupil Pipeline pack request',
                    'Community and Events', 'Packs', 'Count of pack requests made in month', 'Water Resource pack request',
                    'Community and Events', 'Packs', 'Count of pack requests made in month', 'Other pack request',
                    'Community and Events', 'Packs', 'Count of pack requests made in month', 'Leaflets',
                    'Digital', 'Packs', 'Count of pack requests made in month', 'Pupil Pipeline pack request',
                    'Community and Events', 'Faith', 'Count of distinct faith groups making donation in month', 'All'
                ) as (team, target_category, target_description, subcategory)""",
            )
        )

    items = [
        "Pupil Pipeline Pack", "Primary School Pack", "Secondary School Pack", "Leaflet", "General Pack",
        "pupil pipeline pack", "Poster",
    ]
    tables = {
        "calendar": days,
        "months": lambda: month_spine(days()),
        "gift": gifts,
        "regular_gift": regular_gifts,
        "gift_change": changes,
        "gift_attribute": gift_attributes,
        "appeal": appeals,
        "appeal_attribute": appeal_attributes,
        "campaign": lambda: from_nation("campaign_id", "campaign_description", CAMPAIGNS).selectExpr(
            "*", "concat('C', cast(campaign_id as string)) as campaign_identifier"
        ),
        "package": lambda: raw("supplier").selectExpr(
            "s_suppkey as package_id",
            f"""concat(lpad(cast(s_suppkey % 50 as string), 2, '0'), '/', {pick(PACKAGE_CODES, "s_nationkey % 5")}, '/',
                cast(s_suppkey as string)) as package_identifier""",
            "s_name as package_description",
            f"{pick(PACKAGE_CATEGORIES, 's_nationkey % 5')} as package_category",
        ),
        "audience": lambda: from_nation("audience_id", "audience", AUDIENCES),
        "team": lambda: from_nation("team_id", "team", TEAMS),
        "action_type": lambda: from_nation("action_type_id", "action_type", ACTION_TYPES),
        "gift_code": lambda: from_region("gift_code_id", "gift_code_description", GIFT_CODES),
        "payment_type": lambda: from_region("payment_type_id", "payment_type", PAYMENT_TYPES, 1),
        "gift_status": lambda: from_region("gift_status_id", "gift_status", GIFT_STATUSES, 1),
        "action_status": lambda: from_region("action_status_id", "action_status", list(ACTION_STATUSES.values()), 1),
        "instalment_frequency": lambda: from_region("frequency_id", "instalments_per_year", INSTALMENTS),
        "known_descriptor": lambda: warehouse.settled("known_descriptor", lambda: settle(known_descriptors())),
        "group": groups,
        "upper_group": upper_groups,
        "constituent": lambda: raw("customer").selectExpr(
            "c_custkey as constituent_key",
            f"c_custkey + {NEW_PERSON_ID} as constituent_id",
            "case when c_mktsegment = 'MACHINERY' then 'O' else 'I' end as key_indicator",
            "case when c_acctbal < 0 then 'Yes' else 'No' end as is_deceased",
            "case when c_acctbal < -500 then date_add(date'1996-01-01', c_nationkey * 60) end as deceased_date",
            "date_add(date'1999-06-01', c_nationkey * 40) as date_changed",
            "case when c_mktsegment = 'MACHINERY' and c_nationkey < 15 then 'Faith Groups' else 'Other' end as organisation_type",
            "concat('Category ', cast(c_nationkey % 3 as string)) as organisation_category",
            "case when c_nationkey % 4 > 0 then concat('Diocese ', cast(c_nationkey as string)) end as organisation_diocese",
            "c_name as organisation_name",
        ),
        "constituent_code": constituent_codes,
        "appeal_send": lambda: orders().selectExpr(
            f"o_custkey + {NEW_PERSON_ID} as constituent_id",
            f"concat(lpad(cast(o_orderkey % 20 as string), 2, '0'), '/', {pick(APPEAL_CODES, 'o_orderkey % 6')}) as appeal_identifier",
            "date_sub(day, cast(o_orderkey % 400 as int)) as appeal_date",
        ),
        "gift_status_date": status_dates,
        "rg_fact": lambda: orders().selectExpr(
            f"{ORDER_GIFT} as gift_id",
            "case when o_totalprice < 250000 then day end as first_instalment_date",
            f"{pick(GIFT_STATUSES, f'{STATUS_ID} - 1')} as gift_status",
            "case when floor(o_totalprice) % 3 = 0 then 'Yes' else 'No' end as has_been_upgraded",
            f"{money('o_totalprice')} as annual_amount",
        ),
        "cash_gift": lambda: cash(owned_lines(), f"{LINE_GIFT} + sequence as gift_id"),
        "cash_given": lambda: cash(with_owners(raw("lineitem")).filter("has_order")),
        "rg_income": rg_income,
        "action": lambda: actions().selectExpr(
            "event_id as action_id",
            "event_id + 7 as action_system_id",
            "user_id as constituent_key",
            f"cast(array_position({literals(list(ACTION_STATUSES))}, event_type) as int) as action_status_id",
            "cast(floor(value) % 25 as int) as action_type_id",
            f"{day_key('day')} as action_date_key",
            "day as action_date",
        ),
        "action_extra": lambda: actions().selectExpr("event_id + 7 as action_system_id", "date_sub(day, 30) as date_added"),
        "action_attribute": action_attributes,
        "material_sent": lambda: raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber as material_id",
            f"{pick(items, 'l_linenumber - 1')} as item",
            "cast(l_quantity as bigint) as quantity",
            "case when l_returnflag = 'R' then -1 else l_orderkey end as letter_activity_id",
        ),
        "activity": lambda: orders().selectExpr("o_orderkey as activity_id", f"{day_key('day')} as end_date_key"),
        "payment": lambda: orders().selectExpr(
            "o_orderkey as payment_id",
            "o_custkey as constituent_key",
            f"{day_key('day')} as donation_date_key",
            f"{money('o_totalprice')} as amount",
        ),
        "nonfinancial_target": nonfinancial_targets,
        "target": targets,
    }
    warehouse = Warehouse(tables, as_of)
    return warehouse
