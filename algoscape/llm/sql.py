"""SQL of queries whose operators have none beside them; for small tables."""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT x AS u, y AS v FROM link UNION SELECT y, x FROM link),
reach(u, v) AS (SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
least_ AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_ ON u = w.doc_id
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
first_ AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT g.doc_id, g.p FROM g JOIN first_ f ON f.g = g.g WHERE f.m < g.doc_id)),
lists AS (SELECT doc_id, list(q) AS q FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(q), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN q IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(q, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists l ON l.doc_id = w.doc_id
"""
