"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {}

ORACLES["op8_mix_sources"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) || ':' || coalesce(cast(doc_id as varchar), '') as k
  from documents),
t as (select source, cast(sum(size) as hugeint) as s, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from d group by source),
p as (select *, 150 * sum(s) over () as total, 200 * s as cap,
             coalesce(sum(200 * s) over (order by s / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
             sum(w) over (order by s / w, source nulls last rows between current row and unbounded following) as rest from t),
c as (select *, cap * rest <= w * (total - before) as clamped from p),
g as (select *, coalesce(sum(case when clamped then cap end) over (), 0) as used, coalesce(sum(case when not clamped then w end) over (), 0) as open from c),
r as (select source, s, case when clamped then cast(2 * s as double) else cast(w * (total - used) as double) / cast(100 * open as double) end as target from g),
e as (select *, case when s > 0 then cast(floor(target / cast(s as double)) as bigint) else 0 end as whole from r),
u as (select source, k, sum(size) as size from d group by source, k),
o as (select u.source, u.k, u.size + 2 * coalesce(sum(u.size) over (partition by u.source order by u.k rows between unbounded preceding and 1 preceding), 0)
             <= 2 * (e.target - e.whole * e.s) as extra
      from u join e on u.source is not distinct from e.source)
select d.doc_id, d.size, cast(e.s as bigint) as source_size, e.target, cast(d.size * (e.whole + case when o.extra then 1 else 0 end) as bigint) as taken
from d join e on d.source is not distinct from e.source join o on d.source is not distinct from o.source and d.k = o.k
"""

ORACLES["op2_exact_topk"] = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 10
"""

# texts as hex digits, two per byte, so that substrings count bytes
ORACLES["op10_suffix_dedup"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, h, unnest(range(0, cast(length(h) / 2 as bigint) - 99)) as s from d where length(h) >= 200),
k as (select doc_id, s, substring(h, 2 * s + 1, 200) as c from w),
r as (select doc_id, s, row_number() over (partition by c order by doc_id, s) > 1 as again from k),
g as (select doc_id, s, case when s <= max(s + 100) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as new
      from r where again),
n as (select doc_id, s, sum(new) over (partition by doc_id order by s) as span from g),
p as (select doc_id, span, min(s) as a, max(s) + 100 as b from n group by doc_id, span),
x as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from p),
t as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last from x group by doc_id),
y as (select x.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from x join d using (doc_id) group by x.doc_id)
select d.doc_id, cast(length(h) / 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(from_hex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join t using (doc_id) left join y using (doc_id)
"""

_ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_KINDS = [("assign", 1, _ASSIGN, 2, 6), ("access", 2, "AKIA[A-Z0-9]+", 0, 20), ("hex", 3, "[0-9a-f]+", 0, 24), ("owned", 4, "[A-Za-z0-9+/_-]{20,}", 0, 20)]
_MATCHES = " union all ".join(
    f"""select doc_id, source, '{kind}' as kind, {rank} as rank, {least} as least, generate_subscripts(m, 1) as i, unnest(m) as m, unnest(v) as v,
        unnest(list_transform(p[1:len(m)], lambda x: length(x))) as before
        from (select doc_id, source, regexp_extract_all(text, '{regex}', 0) as m, regexp_extract_all(text, '{regex}', {group}) as v,
                     string_split_regex(text, '{regex}') as p from d)"""
    for kind, rank, regex, group, least in _KINDS
)
ORACLES["op6_secret_spans"] = f"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
x as ({_MATCHES}),
e as (select *, cast(sum(before + length(m)) over (partition by doc_id, kind order by i) as bigint) as "end" from x),
c as (select doc_id, source, kind, rank, "end" - length(m) as start, "end", v from e
      where case when kind = 'owned' then regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') else length(v) >= least end),
h as (select v, count(distinct coalesce(source, '')) as owners, count(distinct doc_id) as repositories from c group by v),
o as (select *, case when owners >= 3 or repositories >= 6 then 'copied' when owners = 1 then 'specific' else 'shared' end as class from h),
j as (select c.*, class, repositories from c join o using (v)),
k as (select * from j where kind <> 'owned' or class = 'specific' and not exists (
        select 1 from j b where b.doc_id = j.doc_id and b.kind <> 'owned' and b.start < j."end" and b."end" > j.start)),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             count(*) filter (kind = 'owned') as n_owned, count(*) filter (class = 'specific') as n_specific, count(*) filter (class = 'shared') as n_shared,
             count(*) filter (class = 'copied') as n_copied, max(repositories) as most_repositories,
             string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (kind <> 'owned') as base,
             string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) as spans from k group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_owned, 0) as n_owned, coalesce(n_specific, 0) as n_specific, coalesce(n_shared, 0) as n_shared,
       coalesce(n_copied, 0) as n_copied, coalesce(most_repositories, 0) as most_repositories
from d left join g using (doc_id)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEARCH_TERMS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op12_ranked_search"] = f"""
with d as (select doc_id, {_SEARCH_TERMS} as terms from documents where text is not null),
h as (select doc_id, cast(len(terms) as bigint) as n, terms from d where len(terms) > 0),
g as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from h),
q as (select distinct item_id, unnest({_SEARCH_TERMS}) as term from benchmark where text is not null),
v as (select distinct term from q),
p as (select doc_id, n, term, cast(count(*) as bigint) as tf from (select doc_id, n, unnest(terms) as term from h) semi join v using (term) group by all),
w as (select term, cast(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by term),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) as score
      from q join w using (term) join p using (term), g group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
"""

_AUDIT_TERMS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op13_source_divergence"] = f"""
with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select id, lang, source, term, count(*) as n from (select id, lang, source, unnest({_AUDIT_TERMS}) as term from d) group by all),
k as (select lang, term, sum(n) as total from t group by lang, term having count(*) >= 10),
c as (select lang, source, term, sum(n) as n from t join k using (lang, term) group by all),
gr as (select distinct lang, source from d),
kl as (select lang, count(*) as v, sum(total) as total from k group by lang),
gs as (select gr.lang, gr.source, coalesce(kl.v, 0) as v, coalesce(kl.total, 0) as ltotal, coalesce((select sum(n) from c where c.lang = gr.lang and c.source = gr.source), 0) as total
       from gr left join kl on kl.lang = gr.lang),
p as (select gs.lang, gs.source, k.term, coalesce(c.n, 0) as n,
             cast(1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // (gs.total + 2 * gs.v) as bigint) as p,
             cast(1 + (cast(1000000000 as hugeint) * (k.total + 2)) // (gs.ltotal + 2 * gs.v) as bigint) as q
      from gs join k on k.lang = gs.lang left join c on c.lang = gs.lang and c.source = gs.source and c.term = k.term),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
          from gr a join gr b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
      from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, rank from r where part = 'pair' or rank <= 10
"""
