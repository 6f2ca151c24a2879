"""SQL for the operators' queries that SQL can express: plain statements of the results, with no regard to the operators' methods."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

WARC = """
with p as (select page_id, coalesce(html, '') body from pages),
d as (select page_id, octet_length(encode(body))::bigint payload_bytes, sha256(body) payload_digest from p),
f as (select payload_digest, min(page_id) first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
 case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
 case when payload_bytes >= 100 and page_id <> first then first end refers_to
from d left join f using (payload_digest)
"""

NGRAM = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') ws from documents),
i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) k from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(list_slice(ws, k, k + 3), ' ') g from i),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
r as (select doc_id v, doc_id c from w union select v, b from r join l on a = r.c),
m as (select v, min(c) component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id from w join m on v = w.doc_id left join n on n.doc_id = w.doc_id
"""

#: Windows greedily, turn by turn: a turn opens the next window if the new turns would not leave room for the system turn and (but in the first window) a full history.
CHAT = r"""
with recursive t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') body from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
a as (select *, row_number() over (partition by conv_id order by turn, role, body) nr,
  length('<|im_start|>') + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\s'), chr(10), '\n')) + 1
  + length(regexp_replace(body, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 chars from t),
b as (select *, nr = 1 and role = 'system' sys, ceil(chars / 4.0)::bigint cost from a),
c as (select *, coalesce(max(case when sys then cost end) over (partition by conv_id), 0)::bigint kept,
  row_number() over (partition by conv_id, sys order by nr) k from b),
g as (select conv_id, k, 0 win, cost used from c where not sys and k = 1
  union all select c.conv_id, c.k, case when used + cost > 1024 - kept - (case when win = 0 then 0 else 256 end) then win + 1 else win end,
  case when used + cost > 1024 - kept - (case when win = 0 then 0 else 256 end) then cost else used + cost end
  from g join c on c.conv_id = g.conv_id and c.k = g.k + 1 and not sys),
d as (select c.conv_id, nr, chars, cost, kept, win, sum(cost) over (partition by c.conv_id order by nr) - cost before from g join c on c.conv_id = g.conv_id and c.k = g.k and not sys),
w as (select conv_id, win, min(before) begin, least(256, greatest(0, 1024 - any_value(kept) - sum(cost))) room from d group by 1, 2),
f as (select d.conv_id, chars from d
  union all select d.conv_id, chars from d join w on w.conv_id = d.conv_id and d.win < w.win and before >= begin - room
  union all select c.conv_id, chars from c join w on w.conv_id = c.conv_id where sys
  union all select conv_id, chars from c where sys and conv_id not in (select conv_id from w))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by nr)) turns_sha256,
 length(coalesce(string_agg(case when role = 'assistant' then body end, '' order by nr), ''))::bigint loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then body end, '' order by nr), '')) loss_sha256,
 (select sum(chars)::bigint from f where f.conv_id = c.conv_id) formatted_chars
from c group by conv_id
"""

TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) x, row_number() over () as line from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, a.line, b.vec_id, list_inner_product(a.x, b.x)::bigint score from v a join v b on a.line <> b.line where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by line order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

NEAR = """
with recursive v as (select vec_id, embedding::double[] x from embeddings where embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.95),
n as (select a, count(*) n from l group by 1),
r as (select vec_id v, vec_id c from embeddings union select v, b from r join l on a = r.c),
m as (select v, min(c) component_id from r group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept from embeddings join m on v = vec_id left join n on a = vec_id
"""

REPEATS = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws from documents),
i as (select doc_id, ws, unnest(range(1, len(ws) - 49 + 1)) k from w where len(ws) >= 50),
h as (select doc_id, k, md5(array_to_string(list_slice(ws, k, k + 49), ' ')) g from i),
f as (select g, min(doc_id) first from h group by 1),
b as (select h.doc_id, list(k order by k) ks from h join f using (g) where h.doc_id > first group by 1),
u as (select doc_id, unnest(ks) k from b),
gone as (select distinct doc_id, unnest(range(k, k + 50)) p from u),
words as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p from w),
kept as (select x.doc_id, string_agg(word, ' ' order by x.p) left_, count(*) n from words x left join gone y on x.doc_id = y.doc_id and x.p = y.p where y.p is null group by 1)
select w.doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(left_, '')) kept_sha256 from w left join kept on kept.doc_id = w.doc_id
"""

ORACLES = {"op1_warc": WARC, "op2_ngram_join": NGRAM, "op4_chat": CHAT, "op8_topk": TOPK, "op9_flatgraph": NEAR, "op10_repeats": REPEATS}
