"""DuckDB SQL for operators whose results do not depend on their method."""

from __future__ import annotations

NEAR_DUPLICATES = """
with recursive word as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as r from documents
), shingle as (
  select distinct doc_id, unnest(case when len(r) = 0 then [] when len(r) < 5 then [array_to_string(r, ' ')]
         else list_transform(range(1, len(r) - 3), lambda i: array_to_string(r[i:i + 4], ' ')) end) as g from word
), size as (select doc_id, count(*) as n from shingle group by doc_id
), pair as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingle a join shingle b on a.g = b.g and a.doc_id < b.doc_id group by all
), link as (select x, y from pair join size sx on sx.doc_id = x join size sy on sy.doc_id = y where 100 * k >= 85 * (sx.n + sy.n - k)
), edge as (select x, y from link union all select y, x from link
), reach(x, y) as (select x, y from edge union select reach.x, edge.y from reach join edge on edge.x = reach.y
), top as (select x, least(x, min(y)) as c from reach group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id, coalesce(c, doc_id) = doc_id as kept
from documents left join size using (doc_id) left join top on x = doc_id
"""
