"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


OP1 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_fold("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS key
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win), keys AS (SELECT key, n, list(item) AS items FROM win GROUP BY key, n), hits AS (
  SELECT d.doc_id, d.i, d.n, k.items FROM (
    SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS key FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)
  ) d JOIN keys k ON d.key = k.key AND d.n = k.n
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit_words h ON h.doc_id IS NOT DISTINCT FROM w.doc_id LEFT JOIN items t ON t.doc_id IS NOT DISTINCT FROM w.doc_id
"""

OP5 = rf"""
WITH u AS (
  SELECT page_id, {_fold("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN path <> '' AND (regexp_matches('.' || host, '\.ads\.|\.doubleclick\.|\.casino.*\.|\.torrent.*\.|\.xxx.*\.')
    OR (regexp_matches('.' || host, '\.track.*\.') AND starts_with(path, '/pixel'))
    OR starts_with(path, '/wp-login') OR starts_with(path, '/cgi-bin/') OR starts_with(path, '/adserver/') OR regexp_matches(path, '(?s)^/search/.*/page/'))
    THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT r, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), words AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.p) AS t FROM words w LEFT JOIN gone g ON g.r = w.r AND g.p = w.p WHERE g.p IS NULL GROUP BY w.r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept k ON k.r = d.r
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, line, {_fold(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key
  FROM (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
), f AS (
  SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS keep FROM (SELECT DISTINCT r, doc_id, key FROM l WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5
), j AS (SELECT l.*, f.key IS NOT NULL AND coalesce(l.doc_id, -9223372036854775808) <> f.keep AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

ORACLES = {"op1_decontaminate": OP1, "op5_urls": OP5, "op6_passages": OP6, "op7_linedup": OP7}
