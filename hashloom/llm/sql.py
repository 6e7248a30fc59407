"""DuckDB SQL that the registered queries must equal."""

OP4 = """
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
), w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM w
"""

OP9 = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: w[i:i + 12])) AS x FROM iw WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), g AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), occ AS (SELECT g.r, g.i, g.n, win.item_id FROM g JOIN win USING (n, g)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) END AS g
  FROM d
), u AS MATERIALIZED (SELECT g, min(r) AS c, len(g) AS n FROM (SELECT r, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
m AS MATERIALIZED (SELECT s.r, u.c FROM s JOIN u ON list_sort(s.g) = u.g),
e AS MATERIALIZED (SELECT c, n, unnest(g) AS x FROM u),
f AS MATERIALIZED (SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY k, x) AS i FROM (SELECT e.*, count(*) OVER (PARTITION BY x) AS k FROM e)),
p AS MATERIALIZED (SELECT c, n, x FROM f WHERE i <= n - (80 * n + 99) // 100 + 1),
q AS MATERIALIZED (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT q.a, q.b, an, bn, count(*) AS k FROM q JOIN e x ON x.c = q.a JOIN e y ON y.c = q.b AND y.x = x.x GROUP BY ALL)
  WHERE 100 * k >= 80 * (an + bn - k)
), bi AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(c, o) AS (SELECT c, c FROM u UNION SELECT reach.c, bi.b FROM reach JOIN bi ON bi.a = reach.o),
ids AS (SELECT reach.c, min(s.doc_id) AS component_id FROM reach JOIN m ON m.c = reach.o JOIN s ON s.r = m.r GROUP BY reach.c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(ids.component_id, s.doc_id) AS component_id,
  s.doc_id IS NOT DISTINCT FROM coalesce(ids.component_id, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.r = s.r LEFT JOIN ids ON ids.c = m.c
"""
