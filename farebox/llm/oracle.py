"""DuckDB SQL for the queries of this folder that SQL can express, from the definitions."""

SIMILAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, gram
  FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4
                 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS gram FROM words)),
sizes AS (
  SELECT doc_id, count(gram) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * common >= 85 * (s.n + t.n - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT s.doc_id, n AS n_shingles, c.component_id
FROM sizes s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""

REPEATS = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth
  FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
        FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM texts))),
later AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER w + 100 OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM starts WHERE nth > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM later) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, 0 AS a, min(a) AS b FROM runs GROUP BY doc_id
  UNION ALL
  SELECT doc_id, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) FROM runs),
kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h
  FROM gaps g JOIN texts t USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN sums USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
