"""SQL for the queries that SQL can express on whole tables; the others are tested against brute force."""

from __future__ import annotations

P1 = r"""
with recursive base as (
  select notice_id, coalesce(ente, '') as ente, lower(trim(numero)) as num, coalesce(nullif(lower(trim(tipologia)), ''), nullif(lower(regexp_extract(trim(titolo), '^(\S+)', 1)), '')) as what,
    regexp_replace(regexp_replace(regexp_replace(split_part(lower(trim(dettaglio_url)), '#', 1), '^[a-z]+://', ''), '^www\.', ''), '^([^/:?]+):\d+', '\1') as u, allegati
  from notices where batch_no is not null),
cut as (
  select *, regexp_extract(num, '\b(bis|ter|quater|quinquies)\b', 1) as again, trim(regexp_replace(num, '[\s/]*\b(?:bis|ter|quater|quinquies)\b', '', 'g')) as n,
    list_sort(list_filter(string_split(regexp_replace(u, '^[^?]*\??', ''), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:utm_[a-z_]*|sid|csrf|_|t)(?:=.*)?$'))) as params from base),
form as (
  select *, case when regexp_matches(n, '^n\.?\s*(\d+)\s+del\s+\d{1,2}[/.-]\d{1,2}[/.-](\d{4})$') then '^n\.?\s*(\d+)\s+del\s+\d{1,2}[/.-]\d{1,2}[/.-](\d{4})$'
    when regexp_matches(n, '^(?:n\.?\s*)?(\d+)\s*[/-]\s*(\d{2}|\d{4})$') then '^(?:n\.?\s*)?(\d+)\s*[/-]\s*(\d{2}|\d{4})$' when regexp_matches(n, '^(\d+)\s*\(anno\s+(\d{4})\)$') then '^(\d+)\s*\(anno\s+(\d{4})\)$' end as f from cut),
parts as (
  select *, case when regexp_matches(n, '^(?:n\.?\s*)(\d+)\s+del\s') then regexp_extract(n, '^n\.?\s*(\d+)', 1) when f is not null then regexp_extract(n, '^(?:n\.?\s*)?(\d+)', 1) when regexp_matches(n, '^[a-z]+/\d{4}/\d+$') then regexp_extract(n, '(\d+)$', 1) end as no,
    case when f like '%anno%' then regexp_extract(n, '(\d{4})\)$', 1) when f is not null then regexp_extract(n, '(\d{2}|\d{4})$', 1) when regexp_matches(n, '^[a-z]+/\d{4}/\d+$') then regexp_extract(n, '/(\d{4})/', 1) end as y0 from form),
numbered as (
  select *, case when no is not null and what is not null then what || '|' || cast(case when f is not null and f not like '%anno%' and regexp_matches(n, '\d{4}$') then cast(regexp_extract(n, '(\d{4})$', 1) as int) when cast(y0 as int) < 100 then cast(y0 as int) + 2000 else cast(y0 as int) end as varchar) || '|' || cast(cast(no as bigint) as varchar) || '|' || again end as nkey,
    regexp_replace(split_part(u, '?', 1), '/+$', '') || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as pkey from parts),
files as (
  select distinct notice_id, ente, nkey, regexp_replace(regexp_replace(case when regexp_matches(l, '[?&](?:file|f|filename|name)=') then regexp_extract(l, '[?&](?:file|f|filename|name)=([^&#]*)', 1) else regexp_extract(l, '^([^?#]*)', 1) end, '^.*/', ''), '(?:\.p7m)+$', '') as fkey
  from (select notice_id, ente, nkey, lower(trim(regexp_replace(unnest(allegati), '(?i)%2f', '/', 'g'))) as l from numbered)),
common as (select ente, fkey from files where nkey is not null group by 1, 2 having count(distinct nkey) >= 3),
keys as (
  select ente, 'p' as kind, pkey as key, notice_id from numbered where nullif(pkey, '') is not null union all select ente, 'n', nkey, notice_id from numbered where nkey is not null
  union all select ente, 'f', fkey, notice_id from files where fkey <> '' and not exists (select 1 from common c where c.ente = files.ente and c.fkey = files.fkey)),
firsts as (select ente, kind, key, min(notice_id) as m from keys group by 1, 2, 3 having count(distinct notice_id) > 1),
links as (select distinct k.notice_id as a, f.m as b from keys k join firsts f on k.ente = f.ente and k.kind = f.kind and k.key = f.key where k.notice_id <> f.m),
both_ways as (select a, b from links union select b, a from links),
reach(id, root) as (select a, a from both_ways union select r.id, e.b from reach r join both_ways e on r.root = e.a)
select min(root) as kept_id, id as dup_id from reach group by id having min(root) < id
"""

P2 = r"""
with docs as (select event_id, ente, string_split(raw_text, chr(10)) as l from admin_events where regexp_matches(raw_text, '[^\s\p{Z}\p{Cf}]')),
lines as (select event_id, ente, unnest(range(1, len(l) + 1)) as line_no, unnest(list_transform(l, lambda x: lower(regexp_replace(x, '[^\p{L}]+', '', 'g')))) as k from docs),
total as (select ente, count(*) as n from docs group by 1),
frequent as (select ente, k from (select ente, k, count(distinct event_id) as c from lines where length(k) >= 15 group by 1, 2) join total using (ente) where c >= 4 and c >= n * 0.05 - 1e-9)
select distinct event_id, line_no from lines join frequent using (ente, k)
"""

P4 = r"""
with w as (select 'notices' as tbl, notice_id as id, regexp_extract_all(lower(oggetto), '[\p{L}\p{Nd}]+') as w from notices where oggetto is not null
  union all select 'admin_events', event_id, regexp_extract_all(lower(raw_text), '[\p{L}\p{Nd}]+') from admin_events where raw_text is not null),
e as (select tbl, id, list_distinct(case tbl when 'notices' then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
kept as (select tbl, id, s, len(s) as n from e where len(s) >= case tbl when 'notices' then 10 else 30 end),
flat as (select tbl, id, n, unnest(s) as x from kept),
met as (select a.tbl, a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as c from flat a join flat b on a.tbl = b.tbl and a.x = b.x and a.id < b.id group by all)
select tbl, id_a, id_b from met where c >= (na + nb - c) * case tbl when 'notices' then 0.7 else 0.6 end - 1e-9
"""

P2_CLEANED = f"""
with gone as (select event_id, list(line_no) as g from ({P2}) group by 1), cut as (select event_id, raw_text, string_split(raw_text, chr(10)) as l from admin_events)
select event_id, case when g is null then raw_text else coalesce(array_to_string(list_filter(l, lambda x, i: not list_contains(g, i)), chr(10)), '') end as raw_text, cast(coalesce(len(g), 0) as bigint) as removed from cut left join gone using (event_id)
"""

P4_GROUPS = f"""
with recursive pairs as ({P4}), both_ways as (select tbl, id_a as a, id_b as b from pairs union all select tbl, id_b, id_a from pairs),
reach(tbl, id, root) as (select distinct tbl, a, a from both_ways union select r.tbl, r.id, e.b from reach r join both_ways e on r.tbl = e.tbl and r.root = e.a),
heads as (select tbl, id, min(root) as group_id from reach group by 1, 2), degree as (select tbl, a as id, count(*) as links from both_ways group by 1, 2)
select tbl, id as record_id, group_id, links from heads join degree using (tbl, id)
"""

P5 = "select event_id from admin_events where length(raw_text) > 3000"

ORACLE = {"p1_found": P1, "p2_found": P2, "p2_cleaned": P2_CLEANED, "p4_found": P4, "p4_groups": P4_GROUPS, "p5_found": P5}
