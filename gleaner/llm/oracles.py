"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH digested AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
-- equal rows are numbered
sized AS (
  SELECT doc_id, source, size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || digest || '|' || row_number() OVER (PARTITION BY doc_id, source, digest)), 1, 15))::BIGINT AS hash
  FROM digested),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sources),
-- in the order in which sources meet their limit, what is left for each by weight
levels AS (
  SELECT source, source_size, weight,
         (1.5 * (sum(source_size) OVER ())::DOUBLE
          - 2.0 * coalesce((sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0))
         / (sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
-- the first source that doesn't meet its limit sets the level of all that follow
plan AS (
  SELECT source, source_size,
         least(2.0 * source_size, weight * coalesce((SELECT l.level FROM levels l WHERE l.level * l.weight < 2.0 * l.source_size
                                                     ORDER BY 2.0 * l.source_size / l.weight, l.source NULLS LAST LIMIT 1), 1e300)) AS target
  FROM levels),
goal AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times
  FROM plan),
rooms AS (SELECT source, source_size, target, times, target - times * source_size AS room FROM goal),
-- documents in order of their hash while they stay within the room, or nearly so
run1 AS (
  SELECT s.source, s.hash, r.room, sum(s.size) AS words, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.hash) AS so_far
  FROM sized s JOIN rooms r ON s.source IS NOT DISTINCT FROM r.source WHERE s.size > 0 GROUP BY s.source, s.hash, r.room),
end1 AS (
  SELECT r.source, coalesce(max(u.hash), -1) AS t1, r.room - coalesce(max(u.so_far), 0) AS room
  FROM rooms r LEFT JOIN run1 u ON r.source IS NOT DISTINCT FROM u.source
    AND (u.so_far <= u.room OR (u.so_far - u.room) * 8 < u.room - (u.so_far - u.words)) GROUP BY r.source, r.room),
-- then those that fit into what is left
run2 AS (
  SELECT s.source, s.hash, e.room, sum(s.size) AS words, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.hash) AS so_far
  FROM sized s JOIN end1 e ON s.source IS NOT DISTINCT FROM e.source AND s.hash > e.t1 AND s.size <= floor(e.room) WHERE s.size > 0 GROUP BY s.source, s.hash, e.room),
end2 AS (
  SELECT e.source, e.t1, floor(e.room) AS c2, greatest(e.t1, coalesce(max(u.hash), -1)) AS t2, e.room - coalesce(max(u.so_far), 0) AS room
  FROM end1 e LEFT JOIN run2 u ON e.source IS NOT DISTINCT FROM u.source
    AND (u.so_far <= u.room OR (u.so_far - u.room) * 8 < u.room - (u.so_far - u.words)) GROUP BY e.source, e.t1, e.room),
-- and again; the last one may pass the room if that is nearer
run3 AS (
  SELECT s.source, s.hash, e.room, sum(s.size) AS words, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.hash) AS so_far
  FROM sized s JOIN end2 e ON s.source IS NOT DISTINCT FROM e.source AND s.hash > e.t2 AND s.size <= floor(e.room) WHERE s.size > 0 GROUP BY s.source, s.hash, e.room),
end3 AS (
  SELECT e.source, e.t1, e.c2, e.t2, floor(e.room) AS c3, greatest(e.t2, coalesce(max(u.hash), -1)) AS t3
  FROM end2 e LEFT JOIN run3 u ON e.source IS NOT DISTINCT FROM u.source
    AND (u.so_far <= u.room OR u.so_far - u.room < u.room - (u.so_far - u.words)) GROUP BY e.source, e.t1, e.c2, e.t2, e.room)
SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
       (s.size * (g.times + CASE WHEN s.hash <= e.t1 THEN 1 WHEN s.hash <= e.t2 THEN (s.size <= e.c2)::INTEGER WHEN s.hash <= e.t3 THEN (s.size <= e.c3)::INTEGER ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
JOIN end3 e ON s.source IS NOT DISTINCT FROM e.source
"""

OP3 = """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM rows_),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = r"""
WITH rules(h, p, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT u.host, u.path, r.h || r.p AS rule, r.action,
         row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.h) + length(r.p) DESC, length(r.h) DESC) AS n
  FROM urls u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path AND b.n = 1
"""

_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, n, list_transform(list_filter(range(len(m)), lambda i: length(g[i + 1]) >= {least}), lambda i: {{
           'start': (list_sum(list_transform(b[:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i], lambda x: length(x))), 0))::BIGINT,
           'size': length(m[i + 1])::BIGINT}}) AS spans, '{kind}' AS kind
  FROM (SELECT doc_id, n, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g,
               regexp_split_to_array(text, '{pattern}') AS b FROM docs)"""


OP10 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
found AS ({_found("assign", _ASSIGN, 2, 6)}
  UNION ALL {_found("access", "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_found("hex", "[0-9a-f]+", 0, 24)}),
each AS (
  SELECT n, kind, unnest(spans) AS s FROM found),
joined AS (
  SELECT n, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS k, count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(kind || ':' || s.start || ':' || (s.start + s.size), ',' ORDER BY s.start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans
  FROM each GROUP BY n)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN joined j ON d.n = j.n
"""
