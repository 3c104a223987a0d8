"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

PREFIX_TRIE = f"""
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
own as (select conv_id, list({{'role': role, 'text': text}} order by pos) as seq, {_CRC} % 9 as h from turns group by conv_id),
built as (select o.conv_id, list_concat(list_slice(coalesce(b.seq, []), 1, o.h), list_slice(o.seq, o.h + 1, len(o.seq))) as seq
  from own o left join own b on b.conv_id = o.conv_id - ((o.conv_id % 5) + 5) % 5),
places as (select conv_id, list_slice(seq, 1, d) as node, d, len(seq) as n from built, unnest(range(len(seq) + 1)) as t(d)),
nodes as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id), '') as ids,
  case when d > 0 then (count(*) - 1) * strlen(node[d].text) else 0 end as own_saved from places group by node, d),
kids as (select list_slice(node, 1, d - 1) as up, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.up = n.node and k.d = n.d),
above as (select list_slice(node, 1, u) as node, u as d, sum((n_children = 0)::int) as n_leaves, sum(own_saved) as saved from full_nodes, unnest(range(d + 1)) as t(u) group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, a.n_leaves::bigint as n_leaves, a.saved::bigint as saved_tokens, sha256(n.ids) as ends_sha256
from full_nodes n join above a on a.node = n.node and a.d = n.d left join nodes p on p.node = list_slice(n.node, 1, n.d - 1) and p.d = n.d - 1"""

SUBSTRING_DEDUP = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as h from w, unnest(range(1, len(ws) - 48)) as t(i)),
f as (select h, min(doc_id) as first from p group by h having count(*) > 1),
gone as (select distinct p.doc_id, p.i + o as k from p join f using (h), unnest(range(50)) as t(o) where f.first < p.doc_id),
kept as (select w.doc_id, string_agg(ws[k], ' ' order by k) as s from w, unnest(range(1, len(ws) + 1)) as t(k) where not exists (select 1 from gone where gone.doc_id = w.doc_id and gone.k = t.k) group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from w left join n using (doc_id) left join kept using (doc_id)"""

NGRAM_JOIN = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 2), ' ')) as g from w, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) as t(i)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(id, top) as (select a, a from both_ways union select both_ways.b, reach.top from reach join both_ways on both_ways.a = reach.id and reach.top < both_ways.b),
top as (select id, min(top) as top from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(top.top, w.doc_id)) as component_id from w left join n using (doc_id) left join top on top.id = w.doc_id"""

ORACLE_SQL = {"op5_ngram_join": NGRAM_JOIN, "op7_substring_dedup": SUBSTRING_DEDUP, "op13_prefix_trie": PREFIX_TRIE}
