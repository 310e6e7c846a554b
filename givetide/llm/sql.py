"""DuckDB statements of the queries that SQL can express."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op8_mix"] = r"""
with good as (
  select doc_id, max(case when quality = 1 then 2.0 else 0.5 end) as weight
  from labels where quality is not null and doc_id is not null group by 1),
rows_ as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) as size,
    -ln((('0x' || substr(md5('mix' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0)
      / coalesce(g.weight, 1.0) as key
  from documents d left join good g on d.doc_id = g.doc_id),
weighed as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from rows_ group by source),
passed as (
  select *, 3 * source_size as cap,
    coalesce(sum(3 * source_size) over w, 0) as caps, coalesce(sum(weight) over w, 0) as weights,
    sum(source_size) over () as total, sum(weight) over () as all_weights
  from weighed window w as (order by 3.0 * source_size / weight, source rows between unbounded preceding and 1 preceding)),
level as (
  select arg_min((total - caps)::double / (all_weights - weights), weights) as level from passed
  where caps * weight + cap * (all_weights - weights) >= total * weight),
targets as (select source, source_size, least(weight * level, cap::double) as target from passed, level),
epochs as (select *, floor(target / source_size) as epochs from targets),
placed as (
  select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from rows_)
select p.doc_id, p.source, p.size::bigint as size, e.source_size, e.target,
  (p.size * (e.epochs + case when e.epochs < 3 and before + p.size / 2.0 <= e.target - e.epochs * e.source_size then 1 else 0 end))::bigint as taken
from placed p join epochs e on p.source is not distinct from e.source
"""

STATEMENTS["op4_top_k"] = """
with v as (
  select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

STATEMENTS["op13_repair"] = r"""
with recursive
crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, [0::bigint for k in range(8)]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) r(i))),
keyed as (
  select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
fated as (
  select conv, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(c)::bigint for c in string_split(key, '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as fate
  from keyed, crc_table),
damaged as (
  select conv, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from fated, range(2) r(copy) where fate <> 0 and (copy = 0 or fate = 3)),
placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), copy) as i, left(role, 1) as initial from damaged),
faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    lead(initial) over (partition by conv order by i) as following
  from placed),
places(q, r, "to") as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
nexts(q, "to", role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserted(q, stop, audit, added) as (
  select q, q, '', '' from nexts
  union all
  select i.q, n."to", i.audit || 'I', i.added || chr(10) || n.role || ':' from inserted i join nexts n on i.stop = n.q where len(i.audit) < 4),
edits as (
  select f.conv, f.i, 'D' as letter, 4 as cost, q, q as "to", '' as line from faults f, nexts
  union all
  select f.conv, f.i, 'K', case when fault = 'truncated' then 3 else 0 end, p.q, p."to", chr(10) || f.role || ':' || f.text
  from faults f join places p on p.r = f.initial where fault not in ('blank', 'duplicate')
  union all
  select f.conv, f.i, 'R', case when fault = 'truncated' then 6 else 3 end, n.q, n."to", chr(10) || n.role || ':' || f.text
  from faults f, nexts n where fault not in ('blank', 'duplicate')),
runs(conv, i, q, cost, audit, lines) as (
  select distinct conv, 0::bigint, 0, 0, '', '' from damaged
  union all
  select conv, i, q, b.cost, b.audit, b.lines from (
    select r.conv, e.i, e."to" as q, min({'cost': r.cost + 3 * len(n.audit)::int + e.cost, 'audit': r.audit || n.audit || e.letter, 'lines': r.lines || n.added || e.line}) as b
    from runs r join inserted n on n.q = r.q join edits e on e.conv is not distinct from r.conv and e.i = r.i + 1 and e.q = n.stop
    group by r.conv, e.i, e."to")),
lengths as (select conv, max(i) as n from faults group by conv),
ended as (
  select r.conv, min({'cost': r.cost + 3 * len(n.audit)::int, 'audit': r.audit || n.audit, 'lines': r.lines || n.added}) as b
  from runs r join lengths l on r.conv is not distinct from l.conv and r.i = l.n join inserted n on n.q = r.q where n.stop in (0, 3) group by r.conv),
counts as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (following is not null and initial || following not in ('su', 'ua', 'au')) as illegal
  from faults group by conv)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
  coalesce(b.audit, '') as audit, sha256(coalesce(substr(b.lines, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv is not distinct from o.conv_id
left join ended e on e.conv is not distinct from o.conv_id
"""

STATEMENTS["op12_collocations"] = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents where text is not null)),
grams as (select lang, w[i:i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 4) r(k))),
counts as materialized (select lang, lang || chr(10) || array_to_string(g, ' ') as key, any_value(g) as g, count(*)::hugeint as f from grams group by lang, 2),
totals as (select lang, sum(f) as n from counts where len(g) = 1 group by lang),
candidates as materialized (select lang, g, f as a from counts where len(g) > 1 and f >= 10),
parts as materialized (
  select lang, g, a, k, lang || chr(10) || array_to_string(g[1:k], ' ') as first_part, lang || chr(10) || array_to_string(g[k + 1:], ' ') as rest
  from candidates, range(1, 3) r(k) where k < len(g)),
cuts as (
  select p.*, x.f as l, y.f as r, (1000000 * p.a * p.a) // (x.f * y.f) as score
  from parts p join counts x on x.key = p.first_part join counts y on y.key = p.rest),
least_cut as (select lang, g, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, score * 10 + k)) from cuts group by lang, g, a),
inner_parts as (select lang, unnest([g[1:2], g[2:3]]) as g, a from candidates where len(g) = 3),
covering as (select lang, g, max(a) as a from inner_parts group by lang, g),
kept as (
  select c.* from least_cut c left join covering v on v.lang = c.lang and v.g = c.g
  where v.a is null or 100 * v.a < 50 * c.a),
ranked as (
  select *, array_to_string(g, ' ') as phrase,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from kept)
select r.lang, r.rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, t.n::bigint as n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
