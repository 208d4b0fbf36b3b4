"""DuckDB text of the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""with recursive w as (select doc_id, regexp_extract_all({_LOW.format(c='text')}, '[^\\x20\\x09-\\x0D]+') as l from documents),
 s as (select distinct doc_id, unnest(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as g from w),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
 b as (select x, y from e union all select y, x from e),
 r as (select doc_id, doc_id as c from w union select r.doc_id, b.y from r join b on r.c = b.x),
 m as (select doc_id, min(c) as c from r group by doc_id)
 select w.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from w left join n on w.doc_id = n.doc_id join m on w.doc_id = m.doc_id"""

WARC = """with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
 f as (select h, max(page_id) as f from p where n >= 1000 group by h)
 select p.page_id, p.n as payload_bytes, p.d as payload_digest, case when f.f <> p.page_id then 'revisit' else 'response' end as record_type, case when f.f <> p.page_id then f.f end as refers_to from p left join f on p.h = f.h and p.n >= 1000"""

DECONTAMINATE = f"""with w as (select doc_id, regexp_extract_all({_LOW.format(c='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from documents),
 t as (select cast(item_id as varchar) as item, regexp_extract_all({_LOW.format(c='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from benchmark),
 k as (select item, l, least(13, len(l)) as size from t where len(l) > 0),
 v as (select distinct item, size, array_to_string(l[i:i + size - 1], ' ') as g from (select *, unnest(range(1, len(l) - size + 2)) as i from k) q),
 z as (select distinct size from v),
 d as (select doc_id, size, i, array_to_string(l[i:i + size - 1], ' ') as g from (select doc_id, l, size, unnest(range(1, len(l) - size + 2)) as i from w, z where len(l) >= size) q),
 o as (select d.doc_id, d.i, d.size, v.item from d join v on d.size = v.size and d.g = v.g),
 h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + size)) as j from o) q group by doc_id),
 f as (select doc_id, list_sort(list_distinct(list(item))) as items from o group by doc_id)
 select w.doc_id, len(w.l) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(len(f.items), 0) as n_items, sha256(coalesce(array_to_string(f.items, ','), '')) as items_sha256,
 coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(w.l) as contaminated from w left join h on w.doc_id = h.doc_id left join f on w.doc_id = f.doc_id"""
