"""SQL for DuckDB that gives the rows of operators which SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, pattern: str) -> str:
    """The words of a text as a list, A-Z in lower case; null has none."""
    return f"coalesce(regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{pattern}'), [])"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, row_number() OVER () AS r, {words("text", _SPACED)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM texts WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, far) AS (SELECT x, y FROM either UNION SELECT reach.r, either.y FROM reach JOIN either ON either.x = reach.far),
lowest AS (SELECT reach.r, min(t.doc_id) AS low FROM reach JOIN texts t ON t.r = reach.far GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM texts LEFT JOIN sizes USING (r) LEFT JOIN lowest USING (r)
"""

OP10 = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, {words("text", _ALPHANUMERIC)} AS w FROM documents),
items AS (SELECT coalesce(item_id::varchar, '') AS item, {words("text", _ALPHANUMERIC)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM texts, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT p.r, p.k, p.n, item FROM (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM places) p JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(k, k + n)) AS spot FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
