"""DuckDB SQL for the operators whose rows SQL can express."""

from __future__ import annotations

from .warc import BASE32

OP2 = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as sha, min(page_id) over (partition by html) as first_id from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substring('{BASE32}', (((('0x' || substring(sha, (k // 4) * 5 + 1, 5))::int >> (15 - 5 * (k % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from h"""

OP8 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, unnest(range(0, len(w))) as j, unnest(w) as word, len(w) as n from d),
s as (select doc_id, unnest(range(0, len(w) - 34)) as i, w from d where len(w) >= 35),
k as (select doc_id, i, array_to_string(w[i + 1:i + 35], ' ') as run from s),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by run) as c from k) q where c > 1),
g as (select x.doc_id, x.j, x.word, sum(case when t.i is null then 0 else 1 end) over (partition by x.doc_id order by x.j rows between 34 preceding and current row) > 0 as gone
      from x left join twice t on t.doc_id = x.doc_id and t.i = x.j),
r as (select doc_id, count(*) as n, count(*) filter (where gone) as gone, coalesce(string_agg(word, ' ' order by j) filter (where not gone), '') as kept from g group by doc_id)
select d.doc_id, coalesce(r.n, 0)::bigint as n_words, coalesce(r.gone, 0)::bigint as n_removed, sha256(coalesce(r.kept, '')) as kept_sha256
from d left join r on r.doc_id = d.doc_id"""

OP9 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9e0),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
c as (select x, least(x, min(y)) as component from r group by x),
n as (select x, count(*) as n from l group by x)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component, e.vec_id) as component_id, coalesce(c.component, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.x = e.vec_id left join c on c.x = e.vec_id"""

OP11 = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l, list_transform(range(0, 4), lambda k: ('0x' || substring(h, 8 * k + 1, 8))::bigint) as r from d),
c as (select doc_id, t, l, len(l) as n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) as a, greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from l),
p as (select *, coalesce(array_to_string(l[1:a], ''), '') as pre, coalesce(array_to_string(l[a + 1:b], ''), '') as mid, coalesce(array_to_string(l[b + 1:n], ''), '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p"""

OP12 = """
with v as (select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, embedding::double[] as e from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select vec_id, label, list_transform(e, lambda x: floor(256 * x)) as e from v),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
    from w a join w b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) <= 3"""
