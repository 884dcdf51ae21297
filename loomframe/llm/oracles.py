"""DuckDB SQL for the queries whose whole result SQL can express. Trained models, packing and label scans are tested
against brute-force versions instead."""

URL_FILTER = """
with rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (select page_id, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end rest from pages),
s as (select page_id, rest, regexp_extract(rest, '^[^/]*') host from u),
t as (select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, substr(rest, length(host) + 1) path from s),
best as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) v
  from t join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
select page_id, host, path, rule, coalesce(v, 'allow') verdict from t left join best using (page_id)
"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS.format("text")} ws from documents),
i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) i from d),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') k from i),
f as (select k, min(doc_id) first from w group by 1),
c as (select distinct doc_id, unnest(range(i, i + 13)) i from w join f using (k) where first < doc_id),
a as (select doc_id, len(ws) n_words, unnest(range(1, len(ws) + 1)) i, unnest(ws) w from d),
g as (select a.doc_id, count(c.i) n_removed, coalesce(string_agg(w, ' ' order by a.i) filter (c.i is null), '') kept
  from a left join c on a.doc_id = c.doc_id and a.i = c.i group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join g using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive d as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) x from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(id, label) as (select doc_id, doc_id from documents union select e.b, r.label from r join e on r.id = e.a),
m as (select id doc_id, min(label) component_id from r group by 1)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from m left join n using (doc_id)
"""
