"""DuckDB SQL for the queries that SQL can express: by plain joins, not by the operators' methods."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item against every run of words of that length.
DECONTAMINATION = f"""
with d as (select row_number() over () as row, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select distinct item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null and text is not null),
items as (select item, w, least(len(w), 10) as k from b where len(w) > 0),
windows as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as win from (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from items)),
runs as (select row, k, i, array_to_string(w[i:i + k - 1], ' ') as win from (select row, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from windows) where len(w) >= k)),
hits as (select row, i, k, item from runs join windows using (k, win)),
n as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + k)) as p from hits) group by 1),
found as (select row, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct row, item from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (row) left join found using (row)"""

_FIVE = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

#: Of pages with equal payloads the first is the response. Base 32 is spelt from the digest, twenty bits at a time.
WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, html, min(page_id) as first from p group by all)
select page_id, strlen(p.html)::bigint as payload_bytes, {_FIVE.replace("h, ", "p.h, ")} as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from p join f on p.h = f.h and p.html = f.html"""

#: Lines by their words; equal ones, and those that one word makes equal, against all earlier lines.
LINE_DEDUP = """
with raw as (select doc_id, generate_subscripts(l, 1) as no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
lines as (select *, list_filter(string_split(lower(line), ' '), lambda x: x <> '') as words from raw),
first as (select words, min({'d': doc_id, 'n': no}) as fst, len(words) as n from lines where len(words) > 0 group by words),
v as (select fst, n, words, 0 as i, array_to_string(words, ' ') as z from first where n >= 4 union all
    select fst, n, words, i, array_to_string(words[:i - 1] || words[i + 1:], ' ') from (select fst, n, words, unnest(range(1, n + 1)) as i from first where n >= 4)),
cuts as (select z, i, min(fst) as fst from v group by 1, 2),
early as (select z, min(fst) filter (i = 0) as whole, min(fst) filter (i > 0) as cut from cuts group by 1),
near as (select distinct v.fst from v join cuts c on c.z = v.z and c.i = v.i join early e on e.z = v.z join first o on o.fst = case when v.i = 0 then least(e.cut, e.whole) else least(c.fst, coalesce(e.whole, c.fst)) end
    where o.fst < v.fst and greatest(v.n, o.n) >= 5),
kept as (select l.*, f.fst is not null and (l.doc_id <> f.fst.d or l.no <> f.fst.n or x.fst is not null) as gone from lines l left join first f using (words) left join near x on x.fst = f.fst),
done as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by no) filter (not gone), '') as text from kept group by 1)
select d.doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(n_dropped, 0)::int as n_dropped, case when d.text is null then null else done.text end as text from documents d left join done using (doc_id)"""
