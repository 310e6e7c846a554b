"""SQL for DuckDB that answers each registered query the long way.

The Spark operators avoid month-range joins; the statements here use them, with EXCEPT
and correlated lookups, so that equal results prove the rewrites. The common tables
project the order tables onto their warehouse roles, like ``givetide.sources.roles``.
"""

from __future__ import annotations

from givetide.sources import roles as r

AS_OF = f"date '{r.AS_OF.isoformat()}'"
NOW = r.AS_OF.year * 100 + r.AS_OF.month
STORED_AT = "timestamp '2001-09-15 06:00:00'"


def _list(values: list) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list, index: str) -> str:
    return f"({_list(values)})[cast({index} as int) + 1]"


def _money(sql: str) -> str:
    return f"cast(cast({sql} as decimal(19,2)) as decimal(19,4))"


def _key(day: str) -> str:
    return f"cast(strftime({day}, '%Y%m%d') as int)"


def _month(day: str) -> str:
    return f"cast(strftime({day}, '%Y%m') as int)"


def _label(team: str, campaign: str) -> str:
    arms = " ".join(f"when '{code.lower()}' then '{label}'" for code, label in r.TEAM_LABELS.items())
    return f"case lower({team}) {arms} else {team} || ' - ' || {campaign} end"


STATUS = """case when o_orderstatus = 'O' then 1 when o_orderstatus = 'P' then 2
  when o_orderpriority = '1-URGENT' then 3 when o_orderpriority = '5-LOW' then 4 else 5 end"""
CODE = "cast(left(o_orderpriority, 1) as int) - 2"
PAY = "cast(floor(o_totalprice) as bigint) % 5 + 1"
APPEAL_OF_LINE = "cast(l_quantity * 10 + l_linenumber as int)"
ITEMS = ["Pupil Pipeline Pack", "Primary School Pack", "Secondary School Pack", "Leaflet", "General Pack", "pupil pipeline pack", "Poster"]
GROUP_IDS = [g for g in [*range(24, 94), 998] if g != r.UNLISTED_GROUP]
ORDER_GIFT = f"o_orderkey * {r.LINES_PER_ORDER}"
LINE_GIFT = f"l_orderkey * {r.LINES_PER_ORDER}"

ROLES = f"""
lines as materialized (
  select *, cast(l_shipdate as date) as ship_day, cast(row_number() over (partition by l_orderkey order by l_shipdate,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) as seq
  from lineitem),
owned as (select l.*, o.o_custkey from lines l join orders o on o.o_orderkey = l.l_orderkey),
ord as (select *, cast(o_orderdate as date) as day from orders),
status_date as (
  select case when o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED' then -o_orderkey - 1
      else o_orderkey + {r.SYSTEM_ID} end as gift_system_id, {_pick(r.GIFT_STATUSES, f'{STATUS} - 1')} as status,
    case when o_orderpriority <> '3-MEDIUM' then day + cast(floor(o_totalprice) as int) % 900 end as status_date from ord),
act as (select *, cast(ts as date) - cast({r.EVENT_DAYS_BACK} + user_id * 7 % 700 as int) as day from events),
calendar as materialized (
  select {_key('d')} as date_key, d as date, {_month('d')} as month, cast(year(d) as int) as calendar_year,
    monthname(d) as month_name, cast(year(d) + case when month(d) >= 4 then 1 else 0 end as int) as fiscal_year,
    cast((year({AS_OF}) - year(d)) * 12 + month({AS_OF}) - month(d) as int) as months_since,
    cast({AS_OF} - d as int) as days_since, (d = {AS_OF}) as is_current_date,
    (year(d) = year({AS_OF}) and month(d) = month({AS_OF})) as is_current_month,
    (d >= date '2001-04-01' and d < date '2002-04-01') as is_current_fiscal_year
  from (select cast(unnest(generate_series(
    make_date(cast(year(low) - case when month(low) < 4 then 1 else 0 end as int), 4, 1),
    make_date(cast(year(high) + case when month(high) > 3 then 1 else 0 end as int), 3, 31), interval 1 day)) as date) as d from (
    select least(min(low), {AS_OF}) as low, greatest(max(high), {AS_OF}) as high from (
      select min(cast(o_orderdate as date)) as low, max(cast(o_orderdate as date) + interval 1 year)::date as high from orders
      union all select min(cast(l_shipdate as date)), max(cast(l_shipdate as date)) from lineitem
      union all select min(status_date), max(status_date) from status_date
      union all select min(day) - 30, max(day) from act)))),
months as materialized (select distinct month, calendar_year, month_name, fiscal_year, months_since, is_current_fiscal_year from calendar),
gift as (
  select {ORDER_GIFT} as gift_id, o_orderkey + {r.SYSTEM_ID} as gift_system_id, o_custkey as constituent_key, 30 as gift_type_id,
    {STATUS} as gift_status_id, {CODE} as gift_code_id, {PAY} as payment_type_id, o_custkey % 25 as audience_id,
    o_custkey % 25 as team_id, null as appeal_id, null as package_id, day as gift_date, {_key('day')} as gift_date_key,
    {_key('day + 200')} as changed_date_key, {_money('o_totalprice')} as amount from ord
  union all
  select {LINE_GIFT} + seq, null, o_custkey, case when l_returnflag = 'N' then 1 else 31 end, 4, l_linenumber - 2, 1, l_suppkey % 25,
    l_suppkey % 25, {APPEAL_OF_LINE}, l_suppkey, ship_day, {_key('ship_day')}, {_key('ship_day')}, {_money('l_extendedprice')} from owned),
gift_change as (
  select {LINE_GIFT} + seq as change_id, {LINE_GIFT} as gift_id, o_custkey as constituent_key, seq as sequence,
    cast(seq = 1 as int) as is_original, {_key('ship_day')} as change_date_key, {_money('l_extendedprice')} as amount,
    {_money('l_extendedprice')} * 12 as annual_amount, {_money('l_quantity')} as change_amount,
    cast(case when seq = 1 then cast(l_extendedprice as decimal(19,2)) * 12
      else cast(l_extendedprice as decimal(19,2)) * (cast(l_discount as decimal(4,2)) - cast(l_tax as decimal(4,2))) end
      as decimal(19,4)) as change_annual_amount,
    case when l_linenumber = 7 then -1 else l_linenumber % 5 end as frequency_id,
    case when l_linestatus = 'O' then 0 else l_linenumber % 4 end as previous_frequency_id,
    case when l_linenumber = 6 then -1 else l_suppkey end as package_id, {APPEAL_OF_LINE} as appeal_id, l_suppkey % 25 as campaign_id
  from owned),
appeal as materialized (
  select p_size * 10 + kind as appeal_id, case when p_size >= 48 then 'RA' else lpad(cast(p_size as varchar), 2, '0') end || '/' ||
      {_pick(r.APPEAL_CODES, 'kind - 1')} as appeal_identifier,
    case p_size when 9 then 'Unicef joint' when 8 then 'Unallocated' else 'Appeal' end as appeal_description,
    case when p_size <> 7 then {_pick(r.CATEGORIES, f'(p_size * 6 + kind) % {len(r.CATEGORIES)}')} end as appeal_category,
    {_pick(r.PRODUCTS, f'(p_size * 6 + kind) % {len(r.PRODUCTS)}')} as product, p_size % 25 as campaign_id,
    {_pick(r.CAMPAIGNS, 'p_size % 25')} as campaign_description
  from (select distinct p_size, cast(list_position({_list(r.APPEAL_KINDS)}, p_type) as int) as kind from part)),
appeal_attribute as (
  select appeal_id, 'Product' as category, product as value from appeal
  union all select appeal_id, 'Target Audience', {_pick(r.AUDIENCES, 'appeal_id % 25')} from appeal
    where not suffix(appeal_identifier, 'EV1')),
gift_attribute as (
  select {LINE_GIFT} + seq as gift_id, case when l_linestatus = 'F' then 'Target Audience' else 'Thank you' end as category,
    case when l_linenumber < 4 then {_pick(r.AUDIENCES, 'l_suppkey % 25')} end as value from lines),
campaign as (select n_nationkey as campaign_id, 'C' || n_nationkey as campaign_identifier,
  {_pick(r.CAMPAIGNS, 'n_nationkey')} as campaign_description from nation),
package as materialized (select s_suppkey as package_id, lpad(cast(s_suppkey % 50 as varchar), 2, '0') || '/' ||
    {_pick(r.PACKAGE_CODES, 's_nationkey % 5')} || '/' || s_suppkey as package_identifier, s_name as package_description,
    {_pick(r.PACKAGE_CATEGORIES, 's_nationkey % 5')} as package_category from supplier),
audience as (select n_nationkey as audience_id, {_pick(r.AUDIENCES, 'n_nationkey')} as audience from nation),
team as (select n_nationkey as team_id, {_pick(r.TEAMS, 'n_nationkey')} as team from nation),
action_type as (select n_nationkey as action_type_id, {_pick(r.ACTION_TYPES, 'n_nationkey')} as action_type from nation),
gift_code as (select r_regionkey as gift_code_id, {_pick(r.GIFT_CODES, 'r_regionkey')} as code from region),
payment_type as (select r_regionkey + 1 as payment_type_id, {_pick(r.PAYMENT_TYPES, 'r_regionkey')} as payment_type from region),
gift_status as (select r_regionkey + 1 as gift_status_id, {_pick(r.GIFT_STATUSES, 'r_regionkey')} as gift_status from region),
frequency as (select r_regionkey as frequency_id, {_pick(r.INSTALMENTS, 'r_regionkey')} as per_year from region),
known as materialized (
  select min(descriptor) as descriptor, 40 + length(min(descriptor)) % 20 as default_group,
    {_pick(r.RULE_NUMBERS, f'length(min(descriptor)) % {len(r.RULE_NUMBERS)}')} as rule_number
  from (select {_label('team', 'campaign')} as descriptor from team, (select unnest({_list(r.CAMPAIGNS)}) as campaign)
    union all select {_label('appeal_category', 'campaign_description')} from appeal)
  group by lower(descriptor) having length(min(descriptor)) not in ({', '.join(map(str, r.UNRULED_LENGTHS))})),
groups as materialized (select group_id, 'Group ' || group_id as description,
    cast(group_id % (select count(*) from region) + 10 as int) as forms_part_of, 8 as level
  from (select unnest({_list(GROUP_IDS)}) as group_id)),
constituent as (
  select c_custkey as constituent_key, c_custkey + {r.NEW_PERSON_ID} as constituent_id,
    case when c_mktsegment = 'MACHINERY' then 'O' else 'I' end as key_indicator, c_acctbal < 0 as died,
    case when c_acctbal < -500 then date '1996-01-01' + c_nationkey * 60 end as deceased_date,
    date '1999-06-01' + c_nationkey * 40 as date_changed,
    c_mktsegment = 'MACHINERY' and c_nationkey < 15 as is_faith, 'Category ' || c_nationkey % 3 as organisation_category,
    case when c_nationkey % 4 > 0 then 'Diocese ' || c_nationkey end as organisation_diocese, c_name as organisation_name from customer),
appeal_send as (
  select o_custkey + {r.NEW_PERSON_ID} as constituent_id, lpad(cast(o_orderkey % 20 as varchar), 2, '0') || '/' ||
    {_pick(r.APPEAL_CODES, 'o_orderkey % 6')} as appeal_identifier, day - cast(o_orderkey % 400 as int) as appeal_date from ord),
constituent_code as (
  select c_custkey as constituent_key, 'Schools' as code from customer where c_nationkey < 5
  union all select c_custkey, 'Faith Groups' from customer where c_nationkey > 2 and c_nationkey < 10
  union all select c_custkey, 'General' from customer where c_nationkey > 6),
cash_gift as (
  select {LINE_GIFT} + seq as gift_id, o_custkey + {r.NEW_PERSON_ID} as constituent_id, ship_day as gift_date,
    {_money('l_extendedprice')} as amount, l_linenumber <> 5 as counted from owned where l_returnflag = 'N'),
rg_income as (
  select month, descriptor, payment_type, started, amended, gift_code, sum(value) as value from (
    select {_month('l_shipdate')} as month, {APPEAL_OF_LINE} as appeal_id, {_pick(r.PAYMENT_TYPES, f'{PAY} - 1')} as payment_type,
      case when day < date '2001-04-01' then 'Gift started before this financial year'
        when o_orderpriority <> '5-LOW' then 'Gift started during this financial year' end as started,
      case when l_discount > 0.05 then 'Gift amended during this financial year' else 'Not amended' end as amended,
      case when {CODE} >= 0 then {_pick(r.GIFT_CODES, CODE)} end as gift_code, {_money('l_extendedprice')} as value
    from lineitem join ord on o_orderkey = l_orderkey where l_returnflag <> 'N') x
  left join (select appeal_id, {_label('appeal_category', 'campaign_description')} as descriptor from appeal) a using (appeal_id)
  group by month, appeal_id, descriptor, payment_type, started, amended, gift_code),
action as (
  select event_id as action_id, event_id + 7 as action_system_id, user_id as constituent_key,
    {_pick(list(r.ACTION_STATUSES.values()), f"list_position({_list(list(r.ACTION_STATUSES))}, event_type) - 1")} as action_status,
    cast(floor(value) as int) % 25 as action_type_id, {_key('day')} as action_date_key, day as action_date, day - 30 as date_added from act),
action_attribute as (
  select event_id as action_id, 'Event Name' as category, case when event_type <> 'click' then
    case when event_id % 5 = 0 then 'EVENT ' else 'Event ' end || user_id % 7 || case when event_id % 3 = 0 then ' ' else '' end end as value from events
  union all select event_id, 'Event Registration Type', 'Team' from events where user_id < 75
  union all select event_id, 'Event Category', 'Peer to peer event' from events where user_id % 4 = 0
  union all select event_id, 'Event Category', 'WaterAid Mass Participation Event' from events where user_id % 4 = 1
  union all select event_id, 'Fundraising Platform Used', 'Online page' from events where user_id >= 100),
target as materialized (
  select case g.group_id when 33 then upper(type) when 51 then type || '  ' else type end as type, month, g.group_id, forms_part_of, level, description,
    cast(case when g.group_id = 61 then 0 else total * g.group_id end as decimal(29,4)) as target
  from (select {_month('day')} + 100 as month, sum({_money('o_totalprice')}) as total from ord group by 1),
    (select unnest({_list(r.METRIC_TYPES)}) as type), groups g where g.group_id in ({', '.join(map(str, r.TARGET_GROUPS))})),
nonfinancial as (
  select team, category, what, sub, month, n from (select {_month('day')} as month, cast(count(*) as decimal(19,4)) as n from ord group by 1),
    (values ('Community and Events', 'Packs', 'Count of pack requests made in month', 'Pupil Pipeline pack request'),
      ('Community and Events', 'Packs', 'Count of pack requests made in month', 'Water Resource pack request'),
      ('Community and Events', 'Packs', 'Count of pack requests made in month', 'Other pack request'),
      ('Community and Events', 'Packs', 'Count of pack requests made in month', 'Leaflets'),
      ('Digital', 'Packs', 'Count of pack requests made in month', 'Pupil Pipeline pack request'),
      ('Community and Events', 'Faith', 'Count of distinct faith groups making donation in month', 'All')) k(team, category, what, sub)),
"""

HISTORY = f"""
upgrades as (
  select distinct a.appeal_identifier from appeal a join campaign c using (campaign_id)
  where (lower(appeal_identifier) like '%/u%' and lower(appeal_identifier) not like 'ra/%'
      and lower(appeal_description) not like '%unallocated%' and lower(appeal_description) not like '%unicef%')
    or lower(c.campaign_description) = 'upgrade activity'),
history as materialized (
  select x.*, coalesce(k.default_group, 999) as dash_group from (
    select p.constituent_id, c.gift_id, c.change_id, c.sequence, c.is_original, a.appeal_description, a.appeal_identifier,
      m.campaign_identifier, m.campaign_description, q.package_identifier, q.package_description, c.change_date_key, c.amount,
      c.annual_amount, c.change_amount, c.change_annual_amount, f.per_year as instalments_per_year,
      case when c.sequence <> 1 then b.per_year end as previous_instalments_per_year,
      {_label('s.appeal_category', 's.campaign_description')} as descriptor, gc.code as gift_code,
      g.payment_type_id, g.audience_id, g.gift_status_id, g.gift_system_id
    from gift_change c join gift g on g.gift_id = c.gift_id and g.gift_type_id = 30
    join constituent p on p.constituent_key = c.constituent_key
    left join frequency f on f.frequency_id = c.frequency_id left join frequency b on b.frequency_id = c.previous_frequency_id
    left join package q on q.package_id = c.package_id left join appeal a on a.appeal_id = c.appeal_id
    left join campaign m on m.campaign_id = c.campaign_id
    left join appeal s on lower(s.appeal_identifier) = lower(a.appeal_identifier)
    left join gift_code gc on gc.gift_code_id = g.gift_code_id and g.gift_code_id > -1) x
  left join known k on lower(k.descriptor) = lower(x.descriptor)),
"""

KIND = """case when substr({0}.appeal_identifier, 3, 4) = '/UPR' then 'Welcome'
  when substr({0}.appeal_identifier, 3, 3) = '/UP' or {0}.appeal_identifier in (from upgrades) then 'Non-Welcome upgrade appeal'
  else 'Other' end"""


def _facts(value: str, day_join: str, where: str) -> str:
    return f"""select h.gift_id, {value} as value, d.month, {KIND.format('h')} as appeal_type, h.appeal_identifier,
    q.package_category, a.product, u.audience, h.descriptor, h.gift_code
  from history h {day_join}
  left join package q on lower(q.package_description) = lower(h.package_description)
  join appeal a on lower(a.appeal_identifier) = lower(h.appeal_identifier)
  left join audience u on u.audience_id = h.audience_id {where}"""


FACTS = f"""
new_facts as ({_facts('h.change_annual_amount', 'left join calendar d on d.date_key = h.change_date_key', 'where h.is_original = 1')}),
amend_facts as ({_facts('h.change_annual_amount', 'join calendar d on d.date_key = h.change_date_key',
                        'where h.is_original = 0 and h.change_annual_amount <> 0')}),
cancel_facts as ({_facts('-1 * h.change_annual_amount', '''left join status_date s on s.gift_system_id = h.gift_system_id
    and s.status in ('Terminated', 'Canceled') left join calendar d on d.date = s.status_date''', 'where h.gift_status_id in (3, 5)')}),
"""

# Rule lists as plain CASE arms.
HV = """when lower(audience) = 'high value supporter' and product = 'Direct Solicited Donations' then 73
 when lower(audience) = 'high value supporter' and product = 'Donor Reporting' then 72 """
HV71 = "when lower(audience) = 'high value supporter' then 71 "
SREC_TEST = "(lower(descriptor) like 'supporter recruitment%' or lower(descriptor) like 'srec%')"
SREC = f"""when {SREC_TEST} and product = 'Regular Gifts - Doordrop' then 52
 when {SREC_TEST} and product in ('Regular Gifts - Hothouse', 'Regular Gifts - BRTV', 'Regular Gifts - Hothouse BRTV',
   'Regular Gifts - Hothouse Door Drop') then 63
 when {SREC_TEST} and product = 'Regular Gifts - Inserts' then 35
 when {SREC_TEST} and product = 'Regular Gifts - Word of Mouth' then 62 """
ZERO = "when rule_number = 0 then default_group "
TRUSTS = """when rule_number in (4, 21) and audience = 'Small Trusts' then 75
 when rule_number in (4, 21) and product = 'PPC' then 45
 when rule_number in (4, 21) and product = 'Social Media Advertising' then 61
 when rule_number in (4, 21) then 39 """
SEVEN = "when rule_number = 7 then case when product = 'PSMS - DRTV' then 55 else 33 end "


def _six(other: int, social: bool = True) -> str:
    arm = "when product = 'Social Media Advertising' then 61" if social else ""
    return f"when rule_number = 6 then case when product = 'PPC' then 45 {arm} else {other} end "


UPGRADE_TEST = "rule_number = 23 and lower(product) = 'regular gifts - upgrade and reactivation'"
MAIL_TEST = "package_category in ('Direct Mail', 'Direct Mail Reminder')"
TWENTY = """when rule_number = 20 then case when product = 'PPC' then 45 when product = 'Social Media Advertising' then 61 else 50 end
 when rule_number = 22 then 50 when rule_number = 24 then 49 when rule_number = 26 then 53 else 999 """
SPLIT = f"""when {UPGRADE_TEST} and lower(audience) = 'high value supporter' and package_category = 'Telephone' then 79
 when {UPGRADE_TEST} and lower(audience) = 'high value supporter' and {MAIL_TEST} then 78
 when {UPGRADE_TEST} and appeal_type = 'Welcome' and package_category = 'Telephone' then 37
 when {UPGRADE_TEST} and appeal_type = 'Welcome' and {MAIL_TEST} then 64
 when {UPGRADE_TEST} and appeal_type like 'Non-Welcome%' and package_category = 'Telephone' then 65
 when {UPGRADE_TEST} and appeal_type like 'Non-Welcome%' and {MAIL_TEST} then 66
 when rule_number = 23 then 50 """


def _body(social: bool = True, wide: bool = False) -> str:
    extra = "when rule_number in (17, 18, 19) then 72 " if wide else ""
    return TRUSTS + "when rule_number = 5 then 51 " + _six(54, social) + SEVEN + extra + SPLIT + TWENTY


NEW_CASE = f"case {HV}{SREC}{ZERO}{_body()} end"
CHANGE_CASE = f"case {HV}{ZERO}{SREC}{_body()} end"
CANCEL_CASE = f"case {HV}{SREC}{ZERO}{_body(social=False)} end"
WIDE_CASE = f"case {HV}{HV71}{SREC}{ZERO}{_body(wide=True)} end"

ACTIVE = "(" + " or ".join(
    f"lower(descriptor) like '%{w}%'"
    for w in ("running", "walking", "climbing", "cycling", "other sports", "obstacle", "water related", "triathlon",
              "multi-discipline", "marathon", "adrenaline")
) + ")"
EVCOM = "(lower(descriptor) like 'event%' or lower(descriptor) like 'comm%')"
P2P = f"{EVCOM} and lower(audience) = 'peer to peer fundraiser'"
CASH_CASE = f"""case {HV}{HV71} when rolling_sms then 58 when {P2P} and {ACTIVE} then 84
 when {P2P} and lower(descriptor) like '%in celebration%' then 86 when {P2P} then 87
 when product = 'Glastonbury Festival' then 26 when product in ('WaterAid 200', 'Tough Sh!t') then 88
 when {EVCOM} and {ACTIVE} then 25 when lower(descriptor) like 'event%' then 27
 when audience = 'Faith Groups' then 28 when audience = 'Schools' then 29 when audience = 'Local Groups' then 89
 when audience = 'Choir Groups' then 91 when audience = 'Youth Groups' then 92 when audience = 'Universities' then 93
 when audience in ('Inner Wheel Clubs', 'Lions', 'Other Community Groups', 'Other Professional Groups', 'Other Women''s Groups',
   'Rotary', 'Soroptimist Clubs') then 30
 {SREC}{ZERO}{TRUSTS} when rule_number = 5 and (lower(gift_code) like '%wahoo%' or product = 'Wahoo Gifting') then 46
 when rule_number = 5 then 51 {_six(53)}{SEVEN} when rule_number = 23 then 50 {TWENTY} end"""
INCOME_CASE = """case when gift_code = 'SMS' then 69
 when descriptor is not null and not (lower(descriptor) like 'supporter recruitment team%' or lower(descriptor) like 'null%'
   or lower(descriptor) like 'direct marketing team%' or lower(descriptor) like 'sdev%' or lower(descriptor) like 'srec%'
   or lower(descriptor) like 'supporter development & retention team%' or lower(descriptor) like 'digital marketing team%'
   or lower(descriptor) like 'community team%' or lower(descriptor) like 'comm - not categorised%'
   or lower(descriptor) like 'events team%') then 998
 when (lower(descriptor) like 'community team%' or lower(descriptor) like 'comm - not categorised%')
   and lower(descriptor) not like '%high value%' then 31
 when lower(descriptor) like 'events team%' and lower(descriptor) not like '%high value%' then 27
 when lower(descriptor) like '%upgrade%' and (started like '%during this%' or amended like 'Gift amended%')
   then case when payment_type = 'Direct Debit' then 82 else 83 end
 when lower(descriptor) like '%high value%' then case when payment_type = 'Direct Debit' then 68 else 76 end
 when started like '%before this%' then case when payment_type = 'Direct Debit' then 68 else 76 end
 when started like '%during this%' then case when payment_type = 'Direct Debit' then 80 else 81 end end"""
ACTIVE_EVENT = "lower(action_type) in (" + ", ".join(f"'{t.lower()}'" for t in r.ACTIVE_TYPES) + ")"
EVENT_CASE = f"""case when event_type = 'Peer to peer event' then case when {ACTIVE_EVENT} then 84
   when action_type in ('FR Event - Music/Dancing', 'FR Event - Dinner', 'FR Event - Food and Drink') then 85
   when action_type = 'FR Event - Celebration' then 86 else 87 end
 when event_type = 'WaterAid Mass Participation Event' then 88 when {ACTIVE_EVENT} then 25 else 27 end"""
EVENT_PARENT = "case when event_type = 'Peer to peer event' then 24 else 13 end"
PACK_CASE = "case constituent_type when 'School' then 29 when 'Faith Group' then 28 else 31 end"

CASH = f"""
rolling as (select distinct left(package_identifier, 6) as id from package where package_category = 'SMS'
  and substr(package_identifier, 4, 3) in ('CAC', 'CAD')),
cash_facts as materialized (
  select p.constituent_id, g.gift_id, d.month, g.amount, a.appeal_identifier, a.appeal_identifier in (select id from rolling) as rolling_sms,
    c.code as gift_code, pr.value as product, ta.value as audience, {_label('t.team', 's.campaign_description')} as descriptor
  from gift g join constituent p using (constituent_key) join team t using (team_id) left join appeal a on a.appeal_id = g.appeal_id
  join appeal s on s.appeal_identifier = a.appeal_identifier join calendar d on d.date_key = g.gift_date_key
  left join gift_code c on c.gift_code_id = g.gift_code_id and g.gift_code_id > -1
  left join (select x.gift_id, y.value from gift x join appeal_attribute y on y.appeal_id = x.appeal_id where y.category = 'Product'
    and x.gift_type_id = 1) pr on pr.gift_id = g.gift_id
  left join (select x.gift_id, coalesce(z.value, y.value) as value from gift x join appeal_attribute y on y.appeal_id = x.appeal_id
    left join gift_attribute z on z.gift_id = x.gift_id and z.category = 'Target Audience' and z.value is not null
    where y.category = 'Target Audience' and x.gift_type_id = 1) ta on ta.gift_id = g.gift_id
  where g.gift_type_id = 1),
"""

SIGNUPS = """
signups as materialized (
  select event_year, month, min(event_name) over (partition by rtrim(lower(event_name))) as event_name, registration_type, event_type, platform,
    action_type, event_date_key, signups from (
  select e.calendar_year as event_year, d.month, min(n.value) as event_name, coalesce(rt.value, 'Neither') as registration_type,
    coalesce(et.value, 'Other') as event_type, coalesce(fp.value, '') as platform, t.action_type, a.action_date_key as event_date_key,
    count(p.constituent_id) as signups
  from action a join action_attribute n on n.action_id = a.action_id and n.category = 'Event Name' and n.value is not null
  join action_type t using (action_type_id) join constituent p using (constituent_key)
  join calendar d on d.date = a.date_added and d.months_since > -1 join calendar e on e.date_key = a.action_date_key
  left join action_attribute rt on rt.action_id = a.action_id and rt.category = 'Event Registration Type'
  left join action_attribute et on et.action_id = a.action_id and et.category = 'Event Category'
  left join action_attribute fp on fp.action_id = a.action_id and fp.category = 'Fundraising Platform Used'
  where a.action_status in ('Participating', 'Accepted', 'Participated', 'Pending Approval', 'Day of event')
    and lower(t.action_type) like '%fr event - %'
  group by rtrim(lower(n.value)), e.calendar_year, d.month, coalesce(rt.value, 'Neither'), coalesce(et.value, 'Other'), coalesce(fp.value, ''),
    t.action_type, a.action_date_key)),
sends as materialized (
  select fiscal_year, month, action_type, constituent_type, count(constituent_id) as sends from (
    select distinct p.constituent_id, d.month, a.action_date_key, d.fiscal_year, t.action_type, k.constituent_type
    from action a join action_type t using (action_type_id) join constituent p using (constituent_key)
    join calendar d on d.date = a.action_date and d.months_since > -1
    join (select distinct constituent_id, case code when 'Schools' then 'School' when 'Faith Groups' then 'Faith Group' else 'Neither' end
        as constituent_type from constituent left join constituent_code using (constituent_key)) k on k.constituent_id = p.constituent_id
    where a.action_status = 'Sent' and lower(t.action_type) like '%fr pack - %') group by all),
"""

FILLED = f"""
signup_rows as materialized (
  select 'SignUpsDuringMonth' as type, month, group_id, parent as forms_part_of, 8 as level, g.description, event_name, event_month,
    cast(sum(signups) as bigint) as signups
  from (select *, {EVENT_CASE} as group_id, {EVENT_PARENT} as parent, cast(event_date_key // 100 as int) as event_month from signups)
  left join (select group_id, description from groups) g using (group_id) group by all),
signup_filled as materialized (
  select x.*, m.calendar_year, m.fiscal_year, m.month_name, m.months_since from (
    select * from signup_rows union all
    select *, 0 from (
      select distinct a.type, m.month, a.group_id, a.forms_part_of, a.level, a.description, a.event_name, a.event_month
      from signup_rows a join months m on m.month >= a.month and m.months_since > -1
      except select type, month, group_id, forms_part_of, level, description, event_name, event_month from signup_rows)) x
  join months m using (month)),
pack_rows as materialized (
  select 'ReceivedPackDuringMonth' as type, month, group_id, 14 as forms_part_of, 8 as level, g.description, action_type,
    cast(sum(sends) as bigint) as sends
  from (select *, {PACK_CASE} as group_id from sends) left join (select group_id, description from groups) g using (group_id) group by all),
pack_filled as materialized (
  select x.*, m.calendar_year, m.fiscal_year, m.month_name, m.months_since from (
    select * from pack_rows union all
    select *, 0 from (
      select distinct a.type, m.month, a.group_id, a.forms_part_of, a.level, a.description, a.action_type
      from pack_rows a join months m on m.month >= a.month and m.months_since > -1
      except select type, month, group_id, forms_part_of, level, description, action_type from pack_rows)) x
  join months m using (month)),
"""


def _regular_metric(metric: str, facts: str, case: str, join: str) -> str:
    return f"""select '{metric}' as type, month, x.group_id, g.forms_part_of, g.level, g.description, sum(value) as total
    from (select f.*, {case} as group_id from {facts} f {join} (select lower(descriptor) as d, rule_number, default_group from known) k
      on k.d = lower(f.descriptor)) x left join groups g on g.group_id = x.group_id group by all"""


METRICS = f"""
metrics as materialized (
  {_regular_metric('AnnualValueOfNewRegularGifts', 'new_facts', NEW_CASE, 'left join')} union all
  {_regular_metric('AnnualValueOfChangesToRegularGifts', 'amend_facts', CHANGE_CASE, 'join')} union all
  {_regular_metric('AnnualValueCancelledThisMonth', 'cancel_facts', CANCEL_CASE, 'join')} union all
  select 'ValueOfCashGifts', month, g.group_id, g.forms_part_of, g.level, g.description, sum(amount)
    from (select f.*, {CASH_CASE} as gid from cash_facts f left join (select lower(descriptor) as d, rule_number, default_group from known) k
      on k.d = lower(f.descriptor)) x left join groups g on g.group_id = x.gid group by all union all
  select 'ActualReceivedRGIncome', month, x.group_id, g.forms_part_of, g.level, g.description, sum(value)
    from (select *, {INCOME_CASE} as group_id from rg_income) x left join groups g on g.group_id = x.group_id group by all union all
  select type, month, group_id, forms_part_of, level, description, sum(signups) from signup_filled group by all union all
  select type, month, group_id, forms_part_of, level, description, sum(sends) from pack_filled group by all),
missing as materialized (
  select x.type, x.month, x.group_id, g.forms_part_of, g.level, g.description, 0 as total from (
    select distinct p.month, k.type, k.group_id from (select distinct d.fiscal_year, m.type, m.group_id from metrics m join calendar d using (month)) k
      join (select distinct fiscal_year, month from calendar where months_since > -1) p using (fiscal_year)
    except select month, type, group_id from metrics) x left join groups g using (group_id)),
filled as materialized (select * from metrics union all select * from missing),
compared as materialized (
  select distinct f.*, cast(coalesce(f.month = {NOW}, false) as int) as is_current_month,
    cast(coalesce(f.month > {NOW}, false) as int) as is_future_month,
    cast(coalesce(f.month in (select month from calendar where is_current_fiscal_year), false) as int) as is_in_current_fy,
    coalesce(t.target, 0) as target, f.total - coalesce(t.target, 0) as over_under,
    case when t.target <> 0 and f.total <> 0 then 100 * cast(f.total - t.target as double) / cast(t.target as double) end as pct_over_under
  from filled f full join target t on t.month = f.month and t.group_id = f.group_id and rtrim(lower(t.type)) = rtrim(lower(f.type))
  where f.month >= (select min(month) from target) or t.month >= (select min(month) from target)),
ahead as materialized (
  select t.type, t.month, t.group_id, t.forms_part_of, t.level, t.description, 0 as total, 0 as is_current_month, 1 as is_future_month,
    1 as is_in_current_fy, coalesce(t.target, 0) as target, null as over_under, null as pct_over_under
  from target t join months m using (month)
  join (select rtrim(lower(t.type)) as type, t.month, t.group_id from target t join months m using (month) where m.months_since < 0
    except select rtrim(lower(type)), month, group_id from compared) v on v.type = rtrim(lower(t.type)) and v.month = t.month and v.group_id = t.group_id
  where m.months_since < 0),
working as materialized (select * from compared union all select * from ahead),
unmet as materialized (
  select t.* from target t left join working w on w.group_id = t.group_id and rtrim(lower(w.type)) = rtrim(lower(t.type)) and w.month = t.month
  where w.group_id is null and t.month in (select month from working)),
zero_ytd as materialized (
  select min(type) as type, group_id, sum(target) as ytd_target from unmet
  where month in (select month from calendar where months_since > -1 and is_current_fiscal_year) group by rtrim(lower(type)), group_id),
"""

FILESIZE = f"""
fake as (
  select o.gift_id from (select {ORDER_GIFT} as gift_id, {_pick(r.GIFT_STATUSES, f'{STATUS} - 1')} as status, o_totalprice, {CODE} as code_id from ord) o
  join gift_code c on c.gift_code_id = o.code_id
  where not (o_totalprice < 250000) and status not in ('Held', 'Active') and not (cast(floor(o_totalprice) as bigint) % 3 = 0)
    and c.code = 'Website Direct Debit' and o_totalprice > 1800),
latest as (
  select x.constituent_id, x.gift_id, x.month, x.sequence, y.payment_type, h.annual_amount
  from (select h.constituent_id, h.gift_id, d.month, max(h.sequence) as sequence from history h join calendar d on d.date_key = h.change_date_key
    group by all) x
  join history h on h.gift_id = x.gift_id and h.sequence = x.sequence
  join gift g on g.gift_id = x.gift_id join payment_type y on y.payment_type_id = g.payment_type_id),
details as materialized (select * from latest where gift_id not in (from fake)),
spine as materialized (
  select s.gift_id, m.month from (select gift_id, min(d.month) as first from history h join calendar d on d.date_key = h.change_date_key
    group by gift_id) s join months m on m.month >= s.first and m.month < {NOW}),
"""

CARRIED = f"""
outdated as (
  select r.constituent_id, r.gift_id, s.month, r.payment_type, r.annual_amount, r.sequence
  from spine s join details r on r.gift_id = s.gift_id and r.month <= s.month),
carried as materialized (
  select * from outdated except
  select a.* from outdated a join outdated b using (constituent_id, gift_id, month) where a.sequence < b.sequence),
"""

LIVES = f"""
lives as materialized (
  select constituent_id, x.gift_id, gift_status, setup_month,
    case when gift_status in ('Active', 'Held') then null else changed end as cancel_month,
    case when gift_status = 'Active' then null else m.month end as final_active_month
  from (select p.constituent_id, g.gift_id, s.gift_status, d.month as setup_month,
      case when s.gift_status not in ('Active', 'Held') and e.month is null then cast(g.changed_date_key // 100 as int) else e.month end as changed
    from gift g join constituent p using (constituent_key) join gift_status s using (gift_status_id)
    left join status_date t on t.gift_system_id = g.gift_system_id left join calendar e on e.date = t.status_date
    left join calendar d on d.date = g.gift_date where g.gift_type_id = 30) x
  left join months c on c.month = x.changed left join months m on m.months_since = c.months_since + 1),
real_lives as (select * from lives where gift_id not in (from fake)),
"""

RETENTION = """
retention as materialized (
  select c.month, c.payment_type, l.setup_month, l.cancel_month, count(distinct c.constituent_id) as constituents, count(c.gift_id) as gifts,
    sum(c.annual_amount) as annual_amount
  from carried c full join real_lives l on l.gift_id = c.gift_id group by all),
"""

ROLLING_CASH = f"""
cash_24 as materialized (
  select a.constituent_id, b.month, sum(a.given) as cash_24_months
  from (select constituent_id, d.month, d.months_since, sum(amount) as given from cash_gift c join calendar d on d.date = c.gift_date
    where counted group by all) a
  join months b on a.months_since < b.months_since + 24 and a.months_since > b.months_since - 1
  where b.month < {NOW} group by all),
"""

STATUS_OF = """
status as materialized (
  select * from (
    select coalesce(t.constituent_id, u.constituent_id) as constituent_id, coalesce(t.month, u.month) as month, t.regular_value, u.cash_24_months,
      case when t.regular_value is not null and u.cash_24_months is not null then 'Active CoG and Active Cash'
        when t.regular_value is not null then 'Active CoG only' when u.cash_24_months is not null then 'Active Cash only'
        else 'none' end as giver_category
    from (select c.constituent_id, c.month, sum(c.annual_amount) as regular_value from carried c join real_lives l
      on l.gift_id = c.gift_id and (l.final_active_month >= c.month or l.final_active_month is null) group by all) t
    full join cash_24 u on u.constituent_id = t.constituent_id and u.month = t.month) where giver_category <> 'none'),
individuals as materialized (select * from status where constituent_id not in (select constituent_id from constituent where key_indicator = 'O')),
deceased as (
  select p.constituent_id, min(d.month) as month from constituent p
  join calendar d on d.date > coalesce(p.deceased_date, p.date_changed) and d.days_since > 0
  where p.died and p.key_indicator = 'I' group by 1),
marked as materialized (
  select i.* replace (case when x.month <= i.month then 'Deceased - was ' else '' end || giver_category as giver_category)
  from individuals i left join deceased x on x.constituent_id = i.constituent_id),
"""

WIDE = f"""
wide as materialized (
  select w.*, g.forms_part_of, g.level, g.description as group_description from (
    select v.*, {WIDE_CASE} as group_id from (
      select h.*, a.product, q.package_category, u.audience, {KIND.format('h')} as appeal_type, d.month
      from history h left join package q on lower(q.package_identifier) = lower(h.package_identifier)
      left join appeal a on lower(a.appeal_identifier) = lower(h.appeal_identifier) left join audience u on u.audience_id = h.audience_id
      join calendar d on d.date_key = h.change_date_key) v
    left join (select lower(descriptor) as d, rule_number, default_group from known) k on k.d = lower(v.descriptor)) w
  left join groups g on g.group_id = w.group_id),
by_group as materialized (
  select x.*, y.payment_type, w.change_annual_amount
  from (select constituent_id, gift_id, month, group_id, max(sequence) as sequence from wide group by all) x
  join wide w on w.gift_id = x.gift_id and w.sequence = x.sequence
  join gift g on g.gift_id = x.gift_id join payment_type y on y.payment_type_id = g.payment_type_id),
"""

METRIC_OUT = "type, month, group_id, forms_part_of, level, description, cast(total as double) as total"
COMPARED_OUT = METRIC_OUT + """, is_current_month, is_future_month, is_in_current_fy, cast(target as double) as target,
 cast(over_under as double) as over_under, cast(pct_over_under as double) as pct_over_under"""
HISTORY_OUT = """constituent_id, gift_id, change_id, sequence, is_original, appeal_description, appeal_identifier, campaign_identifier,
 campaign_description, package_identifier, package_description, change_date_key, cast(amount as double) as amount,
 cast(annual_amount as double) as annual_amount, cast(change_amount as double) as change_amount,
 cast(change_annual_amount as double) as change_annual_amount, instalments_per_year, previous_instalments_per_year,
 case when previous_instalments_per_year is null or previous_instalments_per_year = instalments_per_year then 'No' else 'Yes' end as frequency_changed,
 cast(annual_amount - change_annual_amount as double) as previous_annual_amount,
 round(cast(annual_amount - change_annual_amount as double) / previous_instalments_per_year, 6) as previous_instalment_amount,
 round(coalesce(cast(amount as double) - cast(annual_amount - change_annual_amount as double) / previous_instalments_per_year,
   cast(change_amount as double)), 6) as adjusted_change_amount, descriptor, dash_group, gift_code"""
FACT_OUT = "gift_id, cast(value as double) as value, month, appeal_type, appeal_identifier, package_category, product, audience, descriptor, gift_code"
STATUS_OUT = "constituent_id, month, cast(regular_value as double) as regular_value, cast(cash_24_months as double) as cash_24_months, giver_category"
RETENTION_SUMS = "constituents, gifts, cast(annual_amount as double) as annual_amount"


def _classified(facts: str, case: str, join: str, value: str = "value") -> str:
    return f"""select gift_id, month, descriptor, cast({value} as double) as {value}, {case} as group_id from {facts} f
    {join} (select lower(descriptor) as d, rule_number, default_group from known) k on k.d = lower(f.descriptor)"""


def _broken() -> str:
    """Every rule of the constraint report, one plain select for each."""
    keys = [("gift", "gift_id"), ("gift_change", "gift_id, sequence"), ("appeal", "appeal_id"), ("package", "package_id"), ("campaign", "campaign_id"),
            ("calendar", "date_key"), ("appeal", "appeal_identifier"), ("package", "package_identifier"), ("package", "package_description"),
            ("gift", "constituent_key, gift_date_key")]
    names = ("appeal_identifier", "package_identifier", "package_description")
    nulls = [("gift_change", "gift_id"), ("gift_change", "sequence"), ("gift_change", "change_date_key"), ("gift", "appeal_id"), ("gift", "gift_system_id")]
    refers = [("gift_change", "change_date_key", "calendar", "date_key"), ("gift_change", "appeal_id", "appeal", "appeal_id"),
              ("gift_change", "package_id", "package", "package_id"), ("gift", "audience_id", "audience", "audience_id")]
    parts = [
        f"""select 'unique {t}({k})' as rule, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as failing_rows, count(*) filter (n > 1) as failing_keys,
          cast(coalesce(max(n) filter (n > 1), 0) as bigint) as largest, cast(coalesce(sum(n * n), 0) as bigint) as rows_joined
        from (select count(*) as n from {t} where ({k.replace(", ", " is not null and ")} is not null) group by {f"lower(rtrim({k}))" if k in names else k})"""
        for t, k in keys
    ]
    parts += [f"select 'filled {t}({k})', count(*) filter ({k} is null), null, null, null from {t}" for t, k in nulls]
    parts += [
        f"""select 'refers {t}({k}) in {o}({c})', cast(coalesce(sum(n), 0) as bigint), count(*), cast(coalesce(max(n), 0) as bigint), null
        from (select {k}, count(*) as n from {t} where {k} not in (select {c} from {o}) group by 1)"""
        for t, k, o, c in refers
    ]
    return " union all ".join(parts)


def statements() -> dict[str, str]:
    base, hist = ROLES, ROLES + HISTORY
    facts = hist + FACTS
    size = hist + FILESIZE
    metrics = facts + CASH + SIGNUPS + FILLED + METRICS
    carried = size + CARRIED
    lives = carried + LIVES
    status = lives + ROLLING_CASH + STATUS_OF
    wide = hist + WIDE

    def sql(prelude: str, select: str) -> str:
        return f"with {prelude.strip().rstrip(',')}{'' if select[0] == ',' else ' '}{select}"

    tree = """, tree as materialized (
        select group_id, forms_part_of, level, description from groups
        union all select r_regionkey + 10, r_regionkey % 2 + 2, 7, 'Region ' || r_name from region
        union all select distinct r_regionkey % 2 + 2, 1, 6, 'Half ' || r_regionkey % 2 from region
        union all select 1, null, 5, 'Whole'),
      up as (with recursive u as (select group_id, group_id as ancestor from tree
        union all select u.group_id, tree.forms_part_of from u join tree on tree.group_id = u.ancestor where tree.forms_part_of is not null) select * from u)"""
    in_force = """select s.month, b.group_id, b.constituent_id, b.gift_id, b.change_annual_amount
        from spine s join by_group b on b.gift_id = s.gift_id and b.month <= s.month
        left join (select g.gift_id, case when t.status_date is null then 197912 else d.month end as month from status_date t
          join gift g on g.gift_system_id = t.gift_system_id left join calendar d on d.date = t.status_date
          where t.status in ('Terminated', 'Canceled', 'Completed')) c on c.gift_id = b.gift_id
        where c.month is null or s.month < c.month"""
    found = {
        "month_spine": sql(base, """select month, calendar_year, month_name, fiscal_year, months_since, is_current_month, is_current_fiscal_year,
            min(days_since) as days_since_month_end from calendar where date in (select day from ord union select ship_day from lines) group by all"""),
        "constraint_report": sql(base, f"select * from ({_broken()})"),
        "upgrade_appeals": sql(hist, "select appeal_identifier from upgrades"),
        "rolling_sms_appeals": sql(base + CASH, "select id as rolling_sms_appeal from rolling"),
        "descriptor": sql(base, f"""select appeal_id, appeal_category, campaign_description,
            {_label('appeal_category', 'campaign_description')} as descriptor from appeal"""),
        "rg_history": sql(hist, f"select {HISTORY_OUT} from history"),
        "appeal_type": sql(hist, f"select distinct appeal_identifier, {KIND.format('a')} as appeal_type from appeal a"),
        "new_gift_facts": sql(facts, f"select {FACT_OUT} from new_facts"),
        "amendment_facts": sql(facts, f"select {FACT_OUT} from amend_facts"),
        "cancellation_facts": sql(facts, f"select {FACT_OUT} from cancel_facts"),
        "cash_gift_facts": sql(base + CASH, "select * replace (cast(amount as double) as amount) from cash_facts"),
        "event_signups": sql(base + SIGNUPS, "select * from signups"),
        "pack_sends": sql(base + SIGNUPS, "select * from sends"),
        "event_signups_filled": sql(base + SIGNUPS + FILLED, "select * from signup_filled"),
        "pack_sends_filled": sql(base + SIGNUPS + FILLED, "select * from pack_filled"),
        "zero_fill_since_first": sql(base, f"""select constituent_key, month, 0 as total from (
            select distinct p.o_custkey as constituent_key, m.month from ord p join months m on m.month >= {_month('p.day')} and m.months_since > -1
            except select o_custkey, {_month('day')} from ord)"""),
        "latest_state_per_month": sql(size, "select * replace (cast(annual_amount as double) as annual_amount) from latest"),
        "unrealistic_gifts": sql(size, "select gift_id from fake"),
        "every_month_since_start": sql(size, "select gift_id, month from spine"),
        "carry_forward_amounts": sql(carried, "select * replace (cast(annual_amount as double) as annual_amount) from carried"),
        "carry_forward_uncancelled": sql(carried, f"""select c.* replace (cast(annual_amount as double) as annual_amount) from carried c
            left join (select g.gift_id, case when s.status_date is null and s.gift_system_id is null then {NOW}
                when s.status_date is null then 197912 else d.month end as cancelled
              from gift g left join status_date s on s.gift_system_id = g.gift_system_id left join gift_status t on t.gift_status_id = g.gift_status_id
              left join calendar d on d.date = s.status_date
              where t.gift_status in ('Terminated', 'Canceled', 'Completed', 'No Gift Status')) x on x.gift_id = c.gift_id
            where x.cancelled is null or c.month < x.cancelled"""),
        "active_value_by_payment_type": sql(carried, """select payment_type, month, cast(sum(annual_amount) as double) as annual_value,
            count(*) as gifts from carried group by 1, 2"""),
        "gift_lifespan": sql(lives, "select * from lives"),
        "retention_long": sql(lives + RETENTION, f"select month, payment_type, setup_month, cancel_month, {RETENTION_SUMS} from retention"),
        "retention_by_mandate_age": sql(lives + RETENTION, """select month, payment_type, cancellation_status, months_since_setup,
            cast(sum(constituents) as bigint) as constituents, cast(sum(gifts) as bigint) as gifts, cast(sum(annual_amount) as double) as annual_amount
            from (select t.*, case when c.months_since < n.months_since then 'Cancelled in future'
                when c.months_since = n.months_since then 'Cancelled DURING this month'
                when c.months_since is null or n.months_since is null then 'Still active now' else 'Cancelled BEFORE this month' end
                as cancellation_status, cast(s.months_since - n.months_since as int) as months_since_setup
              from retention t left join months c on c.month = t.cancel_month left join months n on n.month = t.month
              left join months s on s.month = t.setup_month) group by all"""),
        "rolling_24_month_cash": sql(base + ROLLING_CASH, "select constituent_id, month, cast(cash_24_months as double) as cash_24_months from cash_24"),
        "giver_status": sql(status, f"select {STATUS_OUT} from status"),
        "exclude_organisations": sql(status, f"select {STATUS_OUT} from individuals"),
        "mark_deceased": sql(status, f"select {STATUS_OUT} from marked"),
        "file_size_actuals": sql(status, """select month, giver_category, count(constituent_id) as people,
            cast(sum(regular_value) as double) as regular_value, cast(sum(cash_24_months) as double) as cash_24_months from marked group by 1, 2"""),
        "crossed_giving": sql(status, f"""select giver_category, gift_type, x.month, cast(sum(total) as double) as total from (
            select p.constituent_id, d.month, 'Cash' as gift_type, sum(g.amount) as total from gift g join constituent p using (constituent_key)
              join calendar d on d.date_key = g.gift_date_key join cash_gift c on c.gift_id = g.gift_id
              where g.gift_type_id = 1 and p.key_indicator = 'I' and c.counted group by all
            union all select p.constituent_id, d.month, 'RG Payment', sum(g.amount) from gift g join constituent p using (constituent_key)
              join calendar d on d.date_key = g.gift_date_key where g.gift_type_id = 31 and p.key_indicator = 'I' group by all) x
            left join marked s on s.constituent_id = x.constituent_id and s.month = x.month where x.month < {NOW} group by all"""),
        "classify_regular_new": sql(facts, _classified("new_facts", NEW_CASE, "left join")),
        "classify_regular_change": sql(facts, _classified("amend_facts", CHANGE_CASE, "join")),
        "classify_regular_cancel": sql(facts, _classified("cancel_facts", CANCEL_CASE, "join")),
        "classify_regular_wide": sql(wide, "select gift_id, sequence, month, cast(change_annual_amount as double) as change_annual_amount, group_id from wide"),
        "classify_cash": sql(base + CASH, _classified("cash_facts", CASH_CASE, "left join", "amount")),
        "classify_rg_income": sql(base, f"select * replace (cast(value as double) as value), {INCOME_CASE} as group_id from rg_income"),
        "classify_event": sql(base + SIGNUPS, f"select *, {EVENT_CASE} as group_id, {EVENT_PARENT} as forms_part_of, 8 as level from signups"),
        "classify_pack": sql(base + SIGNUPS, f"select *, {PACK_CASE} as group_id, 14 as forms_part_of, 8 as level from sends"),
        "monthly_metrics": sql(metrics, f"select {METRIC_OUT} from metrics"),
        "fill_missing_fiscal_months": sql(metrics, f"select {METRIC_OUT} from missing"),
        "compare_to_targets": sql(metrics, f"select {COMPARED_OUT} from compared"),
        "future_targets": sql(metrics, f"select {COMPARED_OUT} from ahead"),
        "zero_income_ytd_targets": sql(metrics, "select type, group_id, cast(ytd_target as double) as ytd_target from zero_ytd"),
        "ytd_results": sql(metrics, f"""select type, group_id, cast(ytd_actual as double) as ytd_actual, cast(ytd_target as double) as ytd_target,
            cast(ytd_over_under as double) as ytd_over_under, cast(ytd_pct_over_under as double) as ytd_pct_over_under, month, forms_part_of, level,
            description, is_current_month, is_future_month, cast(month_actual as double) as month_actual, cast(target as double) as target,
            cast(over_under as double) as over_under, cast(pct_over_under as double) as pct_over_under from (
            select w.type, y.group_id, y.ytd_actual, y.ytd_target, y.ytd_actual - coalesce(y.ytd_target, 0) as ytd_over_under,
              case when y.ytd_target <> 0 and y.ytd_actual <> 0 then 100 * cast(y.ytd_actual - y.ytd_target as double) / cast(y.ytd_target as double) end
              as ytd_pct_over_under, w.month, w.forms_part_of, w.level, w.description, w.is_current_month, w.is_future_month,
              w.total as month_actual, w.target, w.over_under, w.pct_over_under
            from (select rtrim(lower(type)) as type, group_id, sum(case when month < {NOW} then total else 0 end) as ytd_actual,
                sum(case when month < {NOW} then target else 0 end) as ytd_target from working
              where month in (select month from calendar where is_current_fiscal_year) group by 1, 2) y
            join working w on w.group_id = y.group_id and rtrim(lower(w.type)) = y.type
            union select t.type, t.group_id, null, z.ytd_target, null, null, t.month, t.forms_part_of, t.level, t.description,
              cast(t.month = {NOW} as int), 0, 0, t.target, 0 - t.target, null
            from unmet t left join zero_ytd z on z.group_id = t.group_id and rtrim(lower(z.type)) = rtrim(lower(t.type)))"""),
        "long_term_trends": sql(metrics, f"""select {STORED_AT} as date_stored, * replace (cast(total as double) as total) from (
            select f.*, d.fiscal_year, cast(right(cast(f.month as varchar), 2) as int) as month_number, e.days_since_month_end,
              cast(row_number() over (partition by f.type, f.group_id order by f.month, f.forms_part_of, f.level, f.description, f.total) as int)
              as sequence
            from filled f join (select distinct month, fiscal_year from calendar) d using (month)
            join (select month, min(days_since) as days_since_month_end from calendar group by 1) e using (month))
            where days_since_month_end > 15 and type <> 'ActualReceivedRGIncome'"""),
        "widened_history": sql(wide, f"""select {HISTORY_OUT}, product, package_category, audience, appeal_type, month, group_id,
            forms_part_of, level, group_description from wide"""),
        "latest_change_per_group_month": sql(wide, "select * replace (cast(change_annual_amount as double) as change_annual_amount) from by_group"),
        "active_gift_value_by_group": sql(size + WIDE, f"""select month, group_id, count(distinct constituent_id) as givers,
            count(distinct gift_id) as gifts, cast(sum(change_annual_amount) as double) as value from ({in_force}) group by 1, 2"""),
        "active_gifts_by_level": sql(size + WIDE, f"""{tree}, in_force as materialized ({in_force}),
          raised as materialized (select f.*, coalesce(up.ancestor, f.group_id) as above from in_force f left join up on up.group_id = f.group_id),
          summed as (select month, above, sum(n) as givers_summed from (
            select month, above, group_id, count(distinct constituent_id) as n from raised group by all) group by all)
          select r.month, cast(r.above as int) as group_id, cast(tree.forms_part_of as int) as forms_part_of, tree.level, tree.description,
            count(distinct r.constituent_id) as givers, any_value(cast(s.givers_summed as bigint)) as givers_summed, count(distinct r.gift_id) as gifts,
            cast(sum(r.change_annual_amount) as double) as value
          from raised r join summed s on s.month = r.month and s.above is not distinct from r.above left join tree on tree.group_id = r.above
          group by r.month, r.above, tree.forms_part_of, tree.level, tree.description"""),
        "faith_group_payments": sql(base, f"""select o.o_custkey as constituent_key, p.organisation_category, p.organisation_diocese,
            p.organisation_name, {_key('o.day')} as donation_date_key, {_month('o.day')} as month,
            o.o_orderkey as payment_id, cast({_money('o_totalprice')} as double) as amount
            from ord o join constituent p on p.constituent_key = o.o_custkey
            where p.key_indicator = 'O' and p.is_faith and {_month('o.day')} in (select month from nonfinancial where what like 'Count of distinct faith%')"""),
        "last_appeal_attribution": sql(base, """select f.appeal_identifier, d.appeal_description, f.people, cast(f.value as double) as cancelled_value, s.sends, s.people_sent,
            round(cast(f.value as double) / s.sends, 6) as value_per_send, round(cast(f.value as double) / s.people_sent, 6) as value_per_person_sent
          from (select appeal_identifier, count(*) as people, sum(amount) as value from (
              select c.constituent_id, a.appeal_identifier, c.amount,
                row_number() over (partition by c.constituent_id order by a.appeal_date desc, a.appeal_identifier desc, c.ended desc, c.gift_id desc) as nth
              from (select p.constituent_id, g.gift_id, g.amount, t.status_date as ended from status_date t join gift g using (gift_system_id)
                  join constituent p using (constituent_key) where t.status in ('Cancelled', 'Terminated')) c
              join appeal_send a on a.constituent_id = c.constituent_id and a.appeal_date < c.ended)
            where nth = 1 and (appeal_identifier like '14%' or appeal_identifier like '15%') group by 1) f
          left join (select appeal_identifier, count(*) as sends, count(distinct constituent_id) as people_sent from appeal_send group by 1) s using (appeal_identifier)
          left join (select appeal_identifier, min(appeal_description) as appeal_description from appeal group by 1) d using (appeal_identifier)"""),
        "fiscal_year_totals": sql(metrics, """select type, fiscal_year, group_id, forms_part_of, level, description, cast(sum(total) as double) as total
            from metrics join (select distinct month, fiscal_year from calendar) using (month) group by all"""),
        "metrics_by_level": sql(metrics, f"""{tree},
          raised as (select m.type, m.month, coalesce(up.ancestor, m.group_id) as group_id, m.total,
              case when coalesce(up.ancestor, m.group_id) is not distinct from m.group_id then m.total end as own
            from metrics m left join up on up.group_id = m.group_id)
          select x.type, x.month, cast(x.group_id as int) as group_id, cast(forms_part_of as int) as forms_part_of, level, description,
            cast(sum(own) as double) as own_total, cast(sum(total) as double) as total
          from raised x left join tree on tree.group_id = x.group_id group by all"""),
        "pack_requests_vs_target": sql(base, f"""select t.category as target_category, t.what as target_description, t.sub as subcategory,
            d.fiscal_year, t.month, cast(t.n as double) as target_value, count(x.material) as actual_value,
            cast(coalesce(sum(x.quantity), 0) as bigint) as extra_stat_value, 'Sum_IndividualPacksRequested' as extra_stat_description
            from nonfinancial t join (select distinct month, fiscal_year from calendar) d using (month)
            left join (select l_orderkey as material, l_quantity as quantity, {_month('o.day')} as month,
                case when lower({_pick(ITEMS, 'l_linenumber - 1')}) = 'pupil pipeline pack' then 'Pupil Pipeline pack request'
                  when {_pick(ITEMS, 'l_linenumber - 1')} in ('Primary School Pack', 'Secondary School Pack') then 'Water Resource pack request' end as kind
              from lineitem left join ord o on o.o_orderkey = case when l_returnflag = 'R' then -1 else l_orderkey end
              where l_returnflag <> 'R') x on x.kind = t.sub and x.month = t.month
            where t.team = 'Community and Events' and t.what = 'Count of pack requests made in month' and t.sub like '%pack request%' group by all"""),
        "faith_groups_vs_target": sql(base, f"""select t.category as target_category, t.what as target_description, t.sub as subcategory,
            d.fiscal_year, t.month, cast(t.n as double) as target_value, a.faith_groups, cast(a.amount_given as double) as amount_given
            from nonfinancial t join (select distinct month, fiscal_year from calendar) d using (month)
            left join (select {_month('o.day')} as month, count(distinct o.o_custkey) as faith_groups, sum({_money('o_totalprice')}) as amount_given
              from ord o join constituent p on p.constituent_key = o.o_custkey where p.key_indicator = 'O' and p.is_faith group by 1) a
              on a.month = t.month where t.what like 'Count of distinct faith%'"""),
    }
    # A rebuild from a month on must not differ from building all.
    return found | {"file_size_rebuilt": found["file_size_actuals"], "active_gifts_rebuilt": found["active_gift_value_by_group"]}
