"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), bi AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, x.b FROM reach r JOIN bi x ON r.b = x.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l')) AS escaped,
         length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS escaped_role,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS joined
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN joined THEN 6 ELSE 7 + escaped_role + 8 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p(kind, rank, pattern, part, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]{16,}', 0, 16), ('entropy', 3, '[A-Za-z0-9+/_-]{20,}', 0, 20)),
m AS (
  SELECT row, kind, rank, least, regexp_split_to_array(t, pattern) AS b, regexp_extract_all(t, pattern) AS w,
         CASE part WHEN 2 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(t, pattern) END AS g
  FROM d, p WHERE regexp_matches(t, pattern)
), u AS (SELECT row, kind, rank, least, unnest(range(1, len(w) + 1)) AS i, b, w, g FROM m),
s AS (
  SELECT row, kind, rank, least, w[i] AS w, length(g[i]) AS size,
         sum(length(b[i]) + length(w[i])) OVER (PARTITION BY row, kind ORDER BY i) AS e
  FROM u
), spans AS (SELECT row, kind, rank, w, CAST(e - length(w) AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM s WHERE size >= least),
bs AS (SELECT row, list(struct_pack(a := a, e := e)) AS l FROM spans WHERE kind <> 'entropy' GROUP BY row),
c AS (
  SELECT r.*, CASE WHEN regexp_matches(w, '^[0-9+/_-]+$') THEN NULL WHEN regexp_matches(w, '^[0-9a-fA-F]+$') THEN 3.01e0 WHEN regexp_matches(w, '^[A-Z0-9]+$') THEN 3.41e0
         WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') THEN 3.61e0 ELSE 3.71e0 END AS bits
  FROM spans r LEFT JOIN bs USING (row) WHERE kind = 'entropy' AND regexp_matches(w, '[0-9]|[a-z][+/_-]*[A-Z]')
    AND (l IS NULL OR len(list_filter(list_concat([a], list_transform(list_filter(l, lambda x: x.e > a AND x.e < e), lambda x: x.e)),
                                      lambda p: len(list_filter(l, lambda y: y.a <= p AND y.e > p)) = 0)) > 0)
    AND NOT regexp_matches(w, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND NOT regexp_matches(w, '^/?(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4})(?:[_-](?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4}))*[0-9]{0,4}(?:/(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4})(?:[_-](?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4}))*)?[0-9]{0,8})+$')
    AND NOT regexp_matches(w, '^(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4})(?:[_-](?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4}|[0-9]{1,4}))+[0-9]{0,4}$')
    AND NOT regexp_matches(w, '^[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15})*[0-9]{0,4}$') AND NOT regexp_matches(w, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_-]*$')
    AND NOT regexp_matches(w, '^[A-Z0-9]*EXAMPLE(?:KEY)?$')
), h AS (
  SELECT row, a, e, bits, max(list_entropy(string_split(substr(w, i, 20), ''))) AS h
  FROM (SELECT *, unnest(range(1, length(w) - 18)) AS i FROM c WHERE bits IS NOT NULL) GROUP BY ALL
), f AS (
  SELECT row, kind, rank, a, e FROM spans WHERE kind <> 'entropy' UNION ALL SELECT row, 'entropy', 3, a, e FROM h WHERE h >= bits
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (kind <> 'entropy'), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank), '') AS spans, count(*) FILTER (kind = 'entropy') AS n_entropy
FROM d LEFT JOIN f USING (row) GROUP BY row
"""

OP10 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, q AS item_shingles, count(*) AS shared_shingles,
       CAST(count(*) AS DOUBLE) / q AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 80 * q
"""

ORACLES = {"op4_near_dedup": OP4, "op7_secret_scan": OP7, "op8_chat_format": OP8, "op10_decontaminate": OP10}
