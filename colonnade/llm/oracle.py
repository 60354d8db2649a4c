"""DuckDB SQL for the queries that SQL can express."""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.n
"""
