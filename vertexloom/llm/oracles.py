"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * c}) & 31)::BIGINT + 1, 1)" for g in range(4) for c in range(8)
)

OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)
),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY r),
nw AS (SELECT row_number() OVER () AS k, item_id, list_distinct(w[s : s + least(len(w), 13) - 1]) AS ts
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM b WHERE len(w) > 0)),
nt AS MATERIALIZED (SELECT k, item_id, len(ts) AS need, unnest(ts) AS term FROM nw),
dt AS MATERIALIZED (SELECT r, p, term FROM (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE term IN (SELECT term FROM nt)),
np AS MATERIALIZED (SELECT r, k FROM (SELECT DISTINCT r, term FROM dt) JOIN nt USING (term) GROUP BY r, k, need HAVING count(*) = need),
nx AS MATERIALIZED (SELECT np.r, np.k, item_id, need, dt.p, dt.term FROM np JOIN nt USING (k) JOIN dt ON dt.r = np.r AND dt.term = nt.term),
ny AS (SELECT a.r, a.k, a.item_id, a.p FROM nx a JOIN nx c ON c.r = a.r AND c.k = a.k AND c.p BETWEEN a.p AND a.p + 29
       GROUP BY a.r, a.k, a.item_id, a.p, a.need HAVING count(DISTINCT c.term) = a.need),
nz AS (SELECT r, count(DISTINCT item_id) AS n_near FROM ny GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN nz USING (r)
"""

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS k
  FROM conversations
),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
s AS (
  SELECT p.conv_id, perspective, k, coalesce(role = perspective, FALSE) AS own, body,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' || coalesce(' name=' || role, '') END || chr(10) AS head
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id
),
o AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s
)
SELECT conv_id, perspective, 0 AS part, count(*)::INTEGER AS n_turns, count(*) FILTER (own)::INTEGER AS n_own,
       string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
       string_agg(start::BIGINT || '-' || (start + length(body) + 10)::BIGINT, ',' ORDER BY k) FILTER (own) AS mask
FROM o GROUP BY conv_id, perspective
"""

ORACLES = {"op4_decontamination": OP4, "op6_warc": OP6, "op8_top_k": OP8, "op10_chat": OP10}
