"""DuckDB SQL twins of the numbered queries that SQL can express: brute force over the same tables."""

from __future__ import annotations

_DIGIT = "(('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31"
OP2_WARC = f"""with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, strlen(t)::bigint as payload_bytes, sha1(t) as h from p),
b as (select *, max(page_id) over (partition by h) as best,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_DIGIT})::int + 1, 1)), '') as payload_digest from d)
select page_id, payload_bytes, payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type,
  case when page_id <> best then best end as refers_to, true as intact from b"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
OP4_EMBEDDING_DEDUP = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and label is not null and {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as id, vec_id as root from embeddings union select l.b, r.root from r join link l on r.id = l.a),
c as (select id as vec_id, min(root) as component_id from r group by id), n as (select a as vec_id, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c using (vec_id) left join n using (vec_id)"""

OP10_TOPK_SEARCH = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where vec_id is not null and {_FINITE}),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 20"""



def _lloyd(rounds: int = 4, parts: int = 4) -> str:
    """Rounds of assignment and floor means as chained tables; a list's inner products of whole numbers are exact doubles."""
    near = lambda k: (
        f"select x.vec_id, x.label, x.part, x.e, arg_min(b.entry, (x.xx + b.bb - 2 * list_inner_product(x.e, b.e), b.entry)) as entry, "
        f"min(x.xx + b.bb - 2 * list_inner_product(x.e, b.e)) as d from x join b{k} b on x.part = b.part group by all"
    )
    steps = [
        f"""v as (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)) as e from embeddings where {_FINITE}),
x as (select vec_id, label, part, e, list_inner_product(e, e) as xx from (select vec_id, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] as e from v, range({parts}) r(part))),
b0 as (select part, (row_number() over (partition by part order by vec_id) - 1)::int as entry, e, xx as bb from x qualify entry < 256)"""
    ]
    for k in range(rounds):
        steps.append(f"""a{k} as materialized ({near(k)}),
m{k} as (select part, entry, list(m order by pos) as e from (select part, entry, pos, floor(sum(c) / count(*)) as m from (select part, entry, unnest(e) as c, unnest(range(len(e))) as pos from a{k}) group by all) group by all),
b{k + 1} as materialized (select part, entry, e, list_inner_product(e, e) as bb from (select b.part, b.entry, coalesce(m.e, b.e) as e from b{k} b left join m{k} m using (part, entry)))""")
    return "with " + ",\n".join(steps) + f""",
f as (select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from ({near(rounds)}) group by all),
s as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, pos)) as h from (select part, entry, unnest(e) as c, unnest(range(len(e))) as pos from b{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from f, s"""


OP11_VECTOR_CODES = _lloyd()

OP12_DIVERGENCE = r"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as materialized (select lang, term, count(*) as n from w group by all having count(distinct id) >= 3),
c as (select lang, source, term, count(*) as n from w group by all),
l as (select lang, count(*) as v, sum(n) as total from k group by all),
t as (select c.lang, c.source, sum(c.n) as total from c join k using (lang, term) group by all),
g as (select e.lang, e.source, l.v, coalesce(t.total, 0) as total from (select distinct lang, source from d) e left join l using (lang) left join t using (lang, source)),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000 * (coalesce(c.n, 0) + 1)::hugeint // (g.total + g.v)::hugeint)::bigint as p,
  (1 + 1000000000 * (k.n + 1)::hugeint // (l.total + l.v)::hugeint)::bigint as q from g join l using (lang) join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
own as (select lang, source, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from own) where rank <= 200"""

OP13_EXACT_DEDUP = r"""with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last)"""

ORACLES = {
    "op2_warc": OP2_WARC, "op4_embedding_dedup": OP4_EMBEDDING_DEDUP, "op10_topk_search": OP10_TOPK_SEARCH, "op11_vector_codes": OP11_VECTOR_CODES,
    "op12_divergence": OP12_DIVERGENCE, "op13_exact_dedup": OP13_EXACT_DEDUP,
}
