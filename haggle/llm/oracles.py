"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
         r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""
with recursive words as (select doc_id, {_WORDS} as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
  from words),
items as (select doc_id, unnest(s) as sh from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common
  from items a join items b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sets p on p.doc_id = x join sets q on q.doc_id = y
  where 100 * common >= 75 * (len(p.s) + len(q.s) - common)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as r from sets union select reach.doc_id, edges.y from reach join edges on edges.x = reach.r)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r) as component_id, s.doc_id = min(r) as kept
from sets s join reach on reach.doc_id = s.doc_id group by s.doc_id, len(s.s)
""",
    "op10_exact_dedup": """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
      from documents)
""",
    "op8_url_rules": r"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(verdict, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select page_id, rhost || rpath as rule, verdict, length(rhost || rpath) as n from parts join rules
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, max_by(f.rule, f.n) as rule, coalesce(max_by(f.verdict, f.n), 'allow') as verdict
from parts p left join fits f using (page_id) group by p.page_id, p.host, p.path
""",
    "op11_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select *, min(page_id) over (partition by d) as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to from f
""",
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same,
    cast(list_dot_product(a.q, c.q) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
pos as (
  select * from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id,
  cast(row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as integer) as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from pos p join scores n on n.anchor_id = p.anchor_id and not n.same
  and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5
""",
    "op13_collocations": r"""
with pieces as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from cut),
grams as (
  select lang, w[i:i + m - 1] as g, m from starts, range(1, 6) t(m) where i + m - 1 <= len(w)),
f as (select lang, g, any_value(m) as m, count(*) as a from grams group by lang, g having count(*) >= 100),
totals as (select lang, sum(len(w)) as n from cut group by lang),
cand as (select * from f where m >= 2),
gone as (
  select lang, g[1:m - 1] as g, a from cand union all select lang, g[2:m] as g, a from cand),
cuts as (
  select c.lang, c.g, c.a, k, x.a as l, y.a as r, cast(n as bigint) as n,
    (1000::hugeint * c.a * cast(n as bigint)) // (x.a::hugeint * y.a) as score
  from cand c join range(1, 5) t(k) on k < c.m join totals using (lang)
  join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:c.m]
  where not exists (select 1 from gone d where d.lang = c.lang and d.g = c.g and 100 * d.a >= 100 * c.a)),
worst as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank,
  array_to_string(g, ' ') as phrase, a, l, r, n, cast(score as bigint) as score
from worst qualify rank <= 2000
""",
}
