"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others (language model, fingerprints, classifiers, tokenizer, discovered
identifiers, content-defined chunks) are tested against brute force, a round trip
or held-out accuracy in tests/llm.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x <> '')"


_BLANK = r"[\x20\x09-\x0D]+"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op4_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {words(_LOWER, _BLANK)} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(4, len(ws)) - 1], ' ') || '|' || least(4, len(ws)) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id
), low AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, d.doc_id = low.component_id AS kept FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op5_substring": f"""
WITH w AS (
  SELECT doc_id, {words("coalesce(text, '')", _BLANK)} AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS p FROM w)
), own AS (
  SELECT k, min(doc_id) AS o FROM win GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, p + unnest(range(13)) AS q FROM win JOIN own USING (k) WHERE doc_id > o
), g AS (
  SELECT doc_id, list(q) AS qs FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(len(qs), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""",
    "op10_decontaminate": f"""
WITH d AS (
  SELECT doc_id, {words(_LOWER, _OTHER)} AS ws FROM documents
), b AS (
  SELECT item_id, {words(_LOWER, _OTHER)} AS ws FROM benchmark
), item AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM b WHERE len(ws) > 0)
), win AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p FROM d, (SELECT DISTINCT n FROM item))
), hit AS (
  SELECT win.doc_id, win.p, win.n, item.item_id FROM win JOIN item ON item.n = win.n AND item.k = win.k
), w AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS q FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}
