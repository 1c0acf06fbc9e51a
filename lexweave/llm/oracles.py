"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All candidates of each query are scored.
NEIGHBOURS = """
with usable as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), common as (
    select len(e) as dim from usable group by dim order by count(*) desc, dim limit 1
), v as (select vec_id, e from usable, common where len(e) = dim),
scored as (
    select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e) as score
    from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 20
"""

#: Every 400-byte string of every document is counted, by its MD5; texts go as two hex digits a byte.
REPEATS = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (select rid, unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: {'i': i, 'm': md5(substr(h, 2 * i + 1, 800))}), recursive := true) from d),
repeated as (select rid, i from strings qualify count(*) over (partition by m) > 1),
marked as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 400 then 0 else 1 end as fresh from repeated),
numbered as (select rid, i, sum(fresh) over (partition by rid order by i) as span from marked),
spans as (select rid, min(i) as a, max(i) + 400 as b from numbered group by rid, span),
gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from spans),
kept as (
    select rid, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
    from gaps join d using (rid) group by rid
)
select doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from d left join kept using (rid)
"""

#: Windows of all items are joined to the runs of as many words of every document.
DECONTAMINATE = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as ws from benchmark),
w as (
    select distinct item, least(len(ws), 10) as k,
           unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) as g
    from b where len(ws) > 0
), sizes as (select distinct k from w),
runs as (
    select rid, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + k - 1], ' ')}}), recursive := true)
    from d, sizes where len(ws) >= k
), found as (select rid, i, k, item from runs join w using (k, g)),
hits as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(i, i + k)) as pos from found) group by rid),
items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct rid, item from found) group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, n_hit is not null as contaminated
from d left join hits using (rid) left join items using (rid)
"""

#: Every prefix of every rebuilt conversation is grouped, and counted for each of its own prefixes.
PREFIX_TRIE = """
with codes as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(3988292384::bigint, a >> 1) else a >> 1 end)) as tab),
convs as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first) as p from conversations where conv_id is not null group by conv_id),
headed as (
    select conv_id, p, conv_id - ((conv_id % 100) + 100) % 100 as base,
           xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8))) % 6 as h
    from convs, codes
), paths as (
    select c.conv_id, list_concat(coalesce(b.p, [])[:c.h], c.p[c.h + 1:]) as p from headed c left join convs b on b.conv_id = c.base
), member as (select conv_id, len(p) = d as ended, d, p[:d] as k, p[d].text as said from (select conv_id, p, unnest(range(len(p) + 1)) as d from paths)),
nodes as (
    select k, d, min(conv_id) as conv, count(*) as n, (count(*) - 1) * coalesce(max(length(said)), 0) as saved,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends from member group by k, d
), children as (select k[:d - 1] as k, d - 1 as d, count(*) as c from nodes where d > 0 group by all),
counted as (select nodes.*, coalesce(c, 0) as c from nodes left join children using (k, d)),
below as (select k[:u] as k, u as d, sum(case when c = 0 then 1 else 0 end) as leaves, sum(saved) as saved from (select *, unnest(range(d + 1)) as u from counted) group by all)
select x.conv as conv_id, x.d as depth, up.conv as parent_conv_id, x.n as n_convs, x.c as n_children, b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, x.ends as ends_sha256
from counted x join below b using (k, d) left join nodes up on up.d = x.d - 1 and up.k = x.k[:x.d - 1]
"""

ORACLES = {"op3_neighbours": NEIGHBOURS, "op4_repeats": REPEATS, "op6_decontaminate": DECONTAMINATE, "op12_prefix_trie": PREFIX_TRIE}
