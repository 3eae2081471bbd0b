"""DuckDB SQL for the queries of this subpackage that SQL can express. Written the plain way, turn by turn and pair by pair."""

from __future__ import annotations

WORDS = r"length(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"


def _crc_table() -> list[int]:
    """CRC-32 of the sixteen 4-bit values (reflected polynomial EDB88320)."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, 2 * length(s)), lambda k: ((ascii(s[k // 2 + 1]) >> (4 * (k % 2))) & 15)::UBIGINT)),
                         lambda a, x: xor(a >> 4, list_extract({_crc_table()}, (xor(a, x) & 15)::BIGINT + 1)::UBIGINT)), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, {WORDS.format('text')} AS words,
         sha256(length(role) || ':' || role || text) AS g
  FROM (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
        UNION ALL SELECT t.conv_id, 1, t.i, role, text FROM t JOIN c USING (conv_id) WHERE t.i >= c.h)),
p AS (
  SELECT conv_id, d, words, k, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS parent
  FROM (SELECT conv_id, d, words, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
        UNION ALL SELECT conv_id, 0, 0, 'root' FROM c)),
n AS (SELECT k, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(parent) AS parent FROM p GROUP BY k),
m AS (SELECT n.*, coalesce(kids, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS k, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent) USING (k)),
s AS (
  SELECT a.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved
  FROM m x JOIN p a ON a.conv_id = x.conv_id AND a.d <= x.d GROUP BY a.k),
e AS (
  SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, k FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY k)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n u ON u.k = m.parent LEFT JOIN e ON e.k = m.k
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
s AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, coalesce(doc_id < top, false) AS gone FROM l LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    """One pair of steps a round: every vector with its nearest centroid, then the centroids' floors of means."""
    out = ["""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
           f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))"]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, q, m.c AS c, m.d AS d FROM (
    SELECT vec_id, any_value(v.q) AS q, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - o.q[i]) * (v.q[i] - o.q[i])))::BIGINT, 'c': o.c}}) AS m
    FROM v CROSS JOIN c{r} o GROUP BY vec_id))""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = o.c)""")
    return ",\n".join(out) + f"""
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(o.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} o ON o.c = a{rounds}.c
"""


ORACLES: dict[str, str] = {"op11_prefix_trie": TRIE, "op12_line_runs": LINES, "op13_zone_clusters": _clusters()}
