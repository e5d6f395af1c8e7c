"""DuckDB SQL for the catalogue's queries, written independently of the column expressions."""

from __future__ import annotations

SALES = """
sales AS (
  SELECT c_mktsegment AS account, CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS dt, o_orderpriority || ' ' || c_name AS descr,
         CAST(floor(o_totalprice / 4000) * 40 AS DECIMAL(18,2)) AS amt, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

TXNS = """
txns AS (
  SELECT account, CAST(k AS VARCHAR) AS txn_id, 0 AS occurrence, dt AS date, descr AS description, amt AS amount, k AS seq,
         CASE WHEN status <> 'P' THEN amt END AS debit, CASE WHEN status = 'P' THEN amt END AS credit
  FROM sales
)"""

DOCS = """
docs AS (
  SELECT 'doc-' || lpad(CAST(k AS VARCHAR), 10, '0') || '.pdf' AS source_path, amt AS amount,
         CASE WHEN k % 35 <> 0 THEN dt + CAST(k % 9 - 4 AS INTEGER) END AS date, CASE WHEN k % 5 <> 0 THEN descr END AS vendor, k % 11 = 0 AS needs_ocr, k AS doc_ord
  FROM sales WHERE k % 7 = 0
)"""

RAW = """
raw AS (
  SELECT account, k, dt, amt, descr,
         CASE WHEN k % 50 = 0 THEN '31/02/2026' ELSE strftime(dt, '%-d/%-m/%Y') END AS d,
         CASE WHEN k % 50 = 1 THEN '12,3x' WHEN k % 50 = 3 THEN '' WHEN status <> 'P' THEN replace(CAST(amt AS VARCHAR), '.', ',') ELSE '' END AS a,
         CASE WHEN k % 50 = 2 THEN '--' WHEN k % 50 = 3 THEN '' WHEN status = 'P' THEN replace(CAST(amt AS VARCHAR), '.', ',') ELSE '' END AS b
  FROM sales
), judged AS (
  SELECT *, CASE WHEN try_strptime(d, '%d/%m/%Y') IS NULL THEN 'Unparseable date ''' || d || ''': Cannot parse date ''' || d || ''' with format ''dd/mm/yyyy'''
                 WHEN a <> '' AND TRY_CAST(replace(a, ',', '.') AS DECIMAL(18,2)) IS NULL THEN 'Unparseable debit ''' || a || ''': Cannot parse amount ''' || a || ''''
                 WHEN b <> '' AND TRY_CAST(replace(b, ',', '.') AS DECIMAL(18,2)) IS NULL THEN 'Unparseable credit ''' || b || ''': Cannot parse amount ''' || b || ''''
                 WHEN a = '' AND b = '' THEN 'Both debit and credit are missing or empty' END AS reason
  FROM raw
)"""

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\pL\pN\pM_\s]', ' ', 'g'), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row of the usual table."""
    return (
        f"list_last(list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda prev, iv:"
        f" list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda cur, jv:"
        f" list_append(cur, CASE WHEN substr({a}, iv[1], 1) = substr({b}, jv[1], 1) THEN prev[jv[1]] + 1 ELSE greatest(cur[jv[1]], prev[jv[1] + 1]) END), [0::BIGINT]),"
        f" list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))"
    )


def ratio(a: str, b: str) -> str:
    return f"100.0 * (1 - (length({a}) + length({b}) - 2 * {lcs(a, b)}) / CAST(length({a}) + length({b}) AS DOUBLE))"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def outcome(tolerance: int = 0) -> str:
    base = 0.75 if tolerance else 0.8
    return f"""
cand AS (
  SELECT t.account, t.txn_id, t.description, t.seq, d.source_path, d.doc_ord, d.vendor, d.needs_ocr
  FROM txns t JOIN docs d ON abs(t.amount - d.amount) <= {tolerance} AND abs(date_diff('day', d.date, t.date)) <= 3
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY account, doc_ord) AS n FROM cand
), tied AS (
  SELECT *, {sorted_tokens('vendor')} AS v, {sorted_tokens('description')} AS x FROM counted WHERE n > 1 AND vendor <> ''
), scored AS (
  SELECT *, {ratio('v', 'x')} AS score FROM tied
), best AS (
  SELECT *, max(score) OVER (PARTITION BY account, doc_ord) AS top FROM scored
), alone AS (
  SELECT *, sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY account, doc_ord) AS tops FROM best
), resolved AS (
  SELECT account, txn_id, seq, source_path, doc_ord, needs_ocr, CASE WHEN score = top AND tops = 1 AND top >= 60 THEN {base} + 0.2 * score / 100 END AS confidence FROM alone
  UNION ALL
  SELECT account, txn_id, seq, source_path, doc_ord, needs_ocr, CASE WHEN n = 1 THEN {base} END FROM counted WHERE NOT (n > 1 AND coalesce(vendor, '') <> '')
), proposals AS (
  SELECT *, row_number() OVER (PARTITION BY account, txn_id ORDER BY confidence DESC, source_path, doc_ord) AS rank FROM resolved WHERE confidence IS NOT NULL
), links AS (
  SELECT * FROM proposals WHERE rank = 1
), unmatched AS (
  SELECT t.* FROM txns t WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.account = t.account AND l.txn_id = t.txn_id)
), ambiguous AS (
  SELECT account, doc_ord, source_path FROM resolved GROUP BY ALL HAVING max(confidence) IS NULL
), unmatchable AS (
  SELECT a.account, d.doc_ord, d.source_path, d.needs_ocr, CASE WHEN d.date IS NULL THEN 0 ELSE 1 END AS section
  FROM docs d CROSS JOIN (SELECT DISTINCT account FROM txns) a
  WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.account = a.account AND c.doc_ord = d.doc_ord)
  UNION ALL
  SELECT account, doc_ord, source_path, needs_ocr, 2 FROM proposals WHERE rank > 1
), review AS (
  SELECT account, 0 AS section, seq, 'Unmatched transaction: ' || strftime(date, '%Y-%m-%d') || ' | ' || description AS reason FROM unmatched
  UNION ALL SELECT account, 1, doc_ord, 'Ambiguous document: ' || source_path FROM ambiguous
  UNION ALL SELECT account, section + 2, doc_ord, CASE WHEN needs_ocr THEN 'Unmatchable (OCR/no amount+date): ' ELSE 'Unmatchable document: ' END || source_path FROM unmatchable
)"""


def matched(select: str, tolerance: int = 0) -> str:
    return f"WITH {SALES}, {TXNS}, {DOCS}, {outcome(tolerance)} {select}"


PATHS = """
paths AS (
  SELECT doc_id, (['statements/SG/2026', 'statements', 'Documents_2026/x', 'inbox'])[doc_id % 4 + 1] || '/' || source || '_' || CAST(doc_id AS VARCHAR)
         || (['.csv', '.PDF', '.png', '.jpeg', '.txt', '.tiff', ''])[doc_id % 7 + 1] AS path
  FROM documents
), routed AS (
  SELECT *, CASE WHEN regexp_matches(path, '(?:^|/)statements/SG/.*/.*\\.csv$') THEN 0 WHEN regexp_matches(path, 'src1.*\\.csv$') THEN 1
                 WHEN regexp_matches(path, '(?:^|/)Documents_.*\\.[pP]DF$') THEN 2 WHEN regexp_matches(path, '(?:^|/)inbox/src._[^1].*\\.csv$') THEN 4 END AS rule
  FROM paths
)"""

BILLS = """
bills AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2D-DOC12' WHEN 1 THEN 'REF 992026-06-1512 é01/02/20245' ELSE '2D-DOC' END || chr(10) || ' ' || chr(10) || (['Total: ', '1234567', 'ab'])[doc_id % 3 + 1] || chr(10) || 'Montant ' || CAST(doc_id % 2500 AS VARCHAR)
         || CASE WHEN doc_id % 2 = 0 THEN ',' ELSE '.' END || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' EUR' || chr(10) || 'Date '
         || CASE doc_id % 4 WHEN 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%d') WHEN 1 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER), '%d/%m/%Y')
                           WHEN 2 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER), '%d-%m-%Y') ELSE '99/99/2024' END
         || chr(10) || coalesce(text, '') AS t
  FROM documents
)"""


def largest(text: str) -> str:
    hits = rf"regexp_extract_all({text}, '\d{{1,3}}(?:[\s\x{{A0}}]\d{{3}})*[,\.]\d{{2}}|\d+[,\.]\d{{2}}')"
    bare = "replace(replace(replace(h, ' ', ''), chr(160), ''), ',', '.')"
    return f"list_max(list_transform({hits}, lambda h: CASE WHEN regexp_full_match({bare}, '[0-9]+\\.[0-9]{{2}}') THEN TRY_CAST({bare} AS DECIMAL(18,2)) END))"


def first_date(text: str) -> str:
    forms = [(r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"), (r"\d{2}-\d{2}-\d{4}", "%d-%m-%Y")]
    alone = lambda p: rf"(?:^|[^\pL\pN\pM_])({p})(?:$|[^\pL\pN\pM_])"
    return "coalesce(" + ", ".join(f"CAST(try_strptime(nullif(regexp_extract({text}, '{alone(p)}', 1), ''), '{f}') AS DATE)" for p, f in forms) + ")"


def vendor(text: str) -> str:
    line = r"regexp_replace(l, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"
    lines = rf"list_transform(string_split_regex({text}, '\r\n|[\n\v\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {line})"
    words = r"string_split(regexp_replace(x, '\s+', ' ', 'g'), ' ')"
    barcode = (
        "(x = '2D-DOC' OR length(x) <= 2 OR regexp_full_match(x, '[0-9]+') OR (length(x) > 40 AND NOT contains(x, ' '))"
        f" OR (len({words}) >= 4 AND len(list_filter({words}, lambda w: NOT (length(w) > 15 AND regexp_full_match(w, '\\pL+') AND w = upper(w)))) = 0))"
    )
    return f"list_filter({lines}, lambda x: x <> '' AND NOT {barcode})[1]"


MONTH_CASE = "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(["janvier", "févr.", "mars", "avril", "mai", "juin", "juillet", "août", "sept.", "octobre", "nov.", "décembre", "brumaire"])) + " END"

WORDS = """
cells AS (
  SELECT CAST(p_partkey AS BIGINT) AS k, split_part(p_name, ' ', 1) AS a, 'f' || CAST(CAST(floor(p_partkey / 100.0) AS BIGINT) AS VARCHAR) AS file, CAST(floor(p_partkey % 100 / 20.0) AS INTEGER) AS page FROM part
)"""

ORACLE: dict[str, str] = {
    "parse_amount_fr": f"""WITH {SALES}, t AS (
      SELECT k, CASE WHEN k % 10 = 1 THEN ' -' ELSE '' END || replace(format('{{:,}}', k * 13), ',', CASE WHEN k % 2 = 0 THEN ' ' ELSE chr(160) END) || ',' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || CASE WHEN k % 10 = 0 THEN 'e5' ELSE '' END AS s FROM sales
    ), u AS (SELECT k, replace(replace(replace(s, chr(160), ''), ' ', ''), ',', '.') AS s FROM t)
    SELECT k, CASE WHEN NOT contains(s, 'e') THEN abs(TRY_CAST(s AS DECIMAL(18,2))) END AS amount FROM u""",
    "parse_date_fr": f"""WITH {SALES}, t AS (
      SELECT k, CASE k % 10 WHEN 0 THEN '31/02/2026' WHEN 1 THEN strftime(dt, '%-d/%-m/%Y') WHEN 2 THEN strftime(dt, '%Y-%m-%d') ELSE strftime(dt, '%d/%m/%Y') END AS s FROM sales
    ) SELECT k, CAST(try_strptime(s, '%d/%m/%Y') AS DATE) AS date FROM t""",
    "amount_texts": f"WITH {SALES} SELECT k, CAST(amt AS VARCHAR) AS amount_text FROM sales",
    "normalize_description": f"SELECT doc_id, {NORM.format('nfc_normalize(text)')} AS description FROM documents",
    "transaction_id": f"WITH {SALES} SELECT k, sha256(account || '|' || strftime(dt, '%Y-%m-%d') || '|' || CAST(amt AS VARCHAR) || '|' || {NORM.format('descr')}) AS txn_id FROM sales",
    "fuzzy_scores": f"""WITH p AS (
      SELECT c_custkey, {sorted_tokens("c_mktsegment || ' ' || c_name")} AS a, {sorted_tokens("n_name || ' Customer'")} AS b FROM customer JOIN nation ON c_custkey % 25 = n_nationkey
    ) SELECT c_custkey, round({ratio('a', 'b')}, 6) AS score FROM p""",
    "route_files": f"WITH {PATHS} SELECT doc_id, CAST(rule AS BIGINT) AS rule_idx FROM routed",
    "classify_files": f"""WITH {PATHS} SELECT doc_id, CASE WHEN path LIKE '%.csv' THEN CASE WHEN rule IS NULL THEN 'unrouted' ELSE 'statement' END
      WHEN lower(path) LIKE '%.pdf' THEN CASE WHEN rule IS NULL THEN 'document' ELSE 'statement' END WHEN regexp_matches(path, '\\.(png|jpg|jpeg|tiff|bmp)$') THEN 'document' ELSE 'ignored' END AS class FROM routed""",
    "doc_extract_amount": f"WITH {BILLS} SELECT doc_id, {largest('t')} AS amount FROM bills",
    "doc_extract_date": f"WITH {BILLS} SELECT doc_id, {first_date('t')} AS date FROM bills",
    "doc_vendor": f"WITH {BILLS} SELECT doc_id, {vendor('t')} AS vendor FROM bills",
    "document_features": f"""WITH {BILLS}, f AS (SELECT doc_id, {largest('t')} AS a, {first_date('t')} AS d, {vendor('t')} AS v FROM bills)
      SELECT doc_id, CASE WHEN a IS NULL OR d IS NULL THEN 0 ELSE a END AS amount, CASE WHEN a IS NOT NULL THEN d END AS date, v AS vendor, a IS NULL OR d IS NULL AS needs_ocr FROM f""",
    "prelevement_features": f"""WITH {SALES}, t AS (
      SELECT k, 'Facture 12,00' || chr(10) || 'Sera prélevé ' || CASE WHEN k % 2 = 0 THEN 'sur ' ELSE '' END || 'le ' || CAST(k % 31 + 1 AS VARCHAR) || ' ' || {MONTH_CASE} || ' 2025 ' || replace(CAST(amt AS VARCHAR), '.', ',') || ' EUR' AS s
      FROM (SELECT *, k % 13 AS m FROM sales)
    ), g AS (
      SELECT k, regexp_extract(s, 'pr.lev.\\s+(?:sur\\s+)?le\\s+(\\d+)\\s+(\\S+)\\s+(\\d+)\\s+([\\d,]+)', ['d', 'm', 'y', 'a']) AS x FROM t
    ), h AS (
      SELECT k, TRY_CAST(x.y || '-' || CAST(list_position(['janvier', 'févr.', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'sept.', 'octobre', 'nov.', 'décembre'], x.m) AS VARCHAR) || '-' || x.d AS DATE) AS d, CAST(replace(x.a, ',', '.') AS DECIMAL(18,2)) AS a FROM g
    ) SELECT k, d AS debit_date, CASE WHEN d IS NOT NULL THEN a END AS debit_amount FROM h""",
    "parse_failures": f"WITH {SALES}, {RAW} SELECT k, reason FROM judged WHERE reason IS NOT NULL",
    "statement_rows": f"""WITH {SALES}, {RAW}, good AS (
      SELECT k, account, CAST(strptime(d, '%d/%m/%Y') AS DATE) AS date, descr AS description, CAST(nullif(replace(a, ',', '.'), '') AS DECIMAL(18,2)) AS debit, CAST(nullif(replace(b, ',', '.'), '') AS DECIMAL(18,2)) AS credit FROM judged WHERE reason IS NULL
    ), ids AS (
      SELECT *, coalesce(debit, credit) AS amount, sha256(account || '|' || strftime(date, '%Y-%m-%d') || '|' || CAST(coalesce(debit, credit) AS VARCHAR) || '|' || {NORM.format('description')}) AS txn_id FROM good
    ) SELECT k, date, description, debit, credit, amount, txn_id, row_number() OVER (PARTITION BY account, txn_id ORDER BY k) - 1 AS occurrence FROM ids""",
    "occurrence_index": f"WITH {SALES} SELECT k, row_number() OVER (PARTITION BY account, dt, amt ORDER BY k) - 1 AS occurrence FROM sales",
    "pdf_lines_to_txns": f"""WITH {WORDS}, n AS (
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY page, k % 20) AS nth, dense_rank() OVER (PARTITION BY file ORDER BY page) AS pages FROM cells
    ) SELECT file, 2 * nth - 1 + pages AS line_no, lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || '/03/2026' AS raw_date, a || ' N' || CAST(k AS VARCHAR) || ' suite R' || CAST(k AS VARCHAR) AS raw_description,
      CASE WHEN k % 2 = 0 THEN CAST(k % 900 AS VARCHAR) || ',50' END AS raw_debit, CASE WHEN k % 2 = 1 THEN CAST(k % 900 AS VARCHAR) || ',50' END AS raw_credit FROM n""",
    "candidates_exact": f"WITH {SALES}, {TXNS}, {DOCS} SELECT t.account, t.seq AS txn, d.doc_ord AS doc FROM txns t JOIN docs d ON t.amount = d.amount AND abs(date_diff('day', d.date, t.date)) <= 3",
    "candidates_tolerance": f"WITH {SALES}, {TXNS}, {DOCS} SELECT t.account, t.seq AS txn, d.doc_ord AS doc FROM txns t JOIN docs d ON abs(t.amount - d.amount) <= 40 AND abs(date_diff('day', d.date, t.date)) <= 3",
    "match_links": matched("SELECT account, txn_id, source_path, round(confidence, 6) AS confidence FROM links"),
    "match_links_tolerance": matched("SELECT account, txn_id, source_path, round(confidence, 6) AS confidence FROM links", 40),
    "match_unmatched": matched("SELECT account, txn_id FROM unmatched"),
    "match_ambiguous": matched("SELECT account, source_path FROM ambiguous"),
    "match_unmatchable": matched("SELECT account, source_path, CAST(section AS BIGINT) AS section FROM unmatchable"),
    "review_items": matched("SELECT account, CAST(section AS BIGINT) AS section, seq, reason FROM review"),
    "ledger_upsert": f"""WITH {SALES}, {TXNS} SELECT account, txn_id, strftime(date, '%Y-%m-%d') AS date, description, coalesce(CAST(debit AS VARCHAR), '') AS debit, coalesce(CAST(credit AS VARCHAR), '') AS credit,
      strftime(date, '%Y-%m') AS month, '2026-01-02T00:00:00' AS imported_at, seq FROM txns WHERE seq % 3 <> 0""",
    "ledger_set_match": matched("""SELECT t.account, t.txn_id, coalesce(l.source_path, '') AS document, CASE WHEN l.source_path IS NULL THEN '' ELSE 'matched' END AS match_status, round(l.confidence, 6) AS confidence
      FROM txns t LEFT JOIN links l ON l.account = t.account AND l.txn_id = t.txn_id WHERE t.seq % 3 = 0"""),
    "ledger_migrate": f"""WITH {SALES}, {TXNS} SELECT strftime(date, '%Y-%m-%d') AS date, description, CAST(amount AS VARCHAR) AS debit, '' AS credit, '' AS account, '' AS category, txn_id AS transaction_id,
      CAST(CASE WHEN seq % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS occurrence, '' AS document, '' AS archived_path, '' AS match_status, '' AS confidence, '' AS imported_at FROM txns""",
    "ledger_month_summary": f"WITH {SALES}, {TXNS} SELECT account, strftime(date, '%Y-%m') AS month, count(*) AS n_rows, CAST(sum(debit) AS DECIMAL(18,2)) AS debit, CAST(sum(credit) AS DECIMAL(18,2)) AS credit FROM txns GROUP BY ALL",
    "archive_paths": f"""WITH {SALES}, {DOCS}, d AS (
      SELECT *, doc_ord % 6 AS content, 'archive' || CASE WHEN date IS NULL THEN '' ELSE '/' || strftime(date, '%Y/%m') END || '/' || coalesce(strftime(date, '%Y-%m-%d'), 'undated') || '_' || CAST(amount AS VARCHAR)
             || CASE WHEN vendor IS NULL THEN '' ELSE '_' || regexp_replace(regexp_replace(regexp_replace(lower(vendor), '[^\\pL\\pN_]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') END AS stem
      FROM docs
    ), c AS (SELECT stem, content, min(doc_ord) AS first FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY first) - 1 AS i FROM c)
    SELECT doc_ord, d.stem || CASE WHEN i = 0 THEN '' ELSE '_' || CAST(i AS VARCHAR) END || '.pdf' AS target, doc_ord = first AS copied FROM d JOIN r ON d.stem = r.stem AND d.content = r.content""",
    "archive_paths_again": f"""WITH {SALES}, {DOCS}, d AS (
      SELECT *, doc_ord % 6 AS content, 'archive' || CASE WHEN date IS NULL THEN '' ELSE '/' || strftime(date, '%Y/%m') END || '/' || coalesce(strftime(date, '%Y-%m-%d'), 'undated') || '_' || CAST(amount AS VARCHAR)
             || CASE WHEN vendor IS NULL THEN '' ELSE '_' || regexp_replace(regexp_replace(regexp_replace(lower(vendor), '[^\\pL\\pN_]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') END AS stem
      FROM docs
    ), there AS (
      SELECT stem, CASE WHEN doc_ord % 2 = 0 THEN 0 ELSE 1 + doc_ord % 2 END AS i, min_by(doc_ord % 4, md5(CAST(doc_ord % 4 AS VARCHAR))) AS content FROM d WHERE doc_ord % 3 = 0 GROUP BY ALL
    ), c AS (
      SELECT d.stem, d.content, min(doc_ord) AS first, min(there.i) AS here FROM d LEFT JOIN there ON there.stem = d.stem AND there.content = d.content GROUP BY ALL
    ), fresh AS (
      SELECT *, row_number() OVER (PARTITION BY stem ORDER BY first) AS n FROM c WHERE here IS NULL
    ), used AS (
      SELECT stem, i FROM there
      UNION SELECT a.stem, TRY_CAST(regexp_extract(b.stem, '_([0-9]+)$', 1) AS BIGINT) FROM (SELECT DISTINCT stem FROM d) a JOIN (SELECT DISTINCT stem FROM d) b ON regexp_matches(b.stem, '_[0-9]+$') AND a.stem = regexp_replace(b.stem, '_[0-9]+$', '')
    ), free AS (
      SELECT stem, i, row_number() OVER (PARTITION BY stem ORDER BY i) AS n FROM (SELECT stem, unnest(range(0, count(*) + 10)) AS i FROM fresh GROUP BY stem) f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.stem = f.stem AND u.i = f.i)
    ), r AS (
      SELECT stem, content, first, here AS i, false AS new FROM c WHERE here IS NOT NULL
      UNION ALL SELECT fresh.stem, content, first, free.i, true FROM fresh JOIN free ON free.stem = fresh.stem AND free.n = fresh.n
    ) SELECT doc_ord, d.stem || CASE WHEN i = 0 THEN '' ELSE '_' || CAST(i AS VARCHAR) END || '.pdf' AS target, new AND doc_ord = first AS copied FROM d JOIN r ON d.stem = r.stem AND d.content = r.content""",
    "run_report": f"""WITH {SALES}, {TXNS}, {DOCS}, {outcome()}, {RAW}
      SELECT (SELECT count(*) FROM txns WHERE seq % 3 <> 0) AS rows_added, CAST(0 AS BIGINT) AS rows_updated, (SELECT count(*) FROM links) AS docs_matched, (SELECT count(*) FROM review) AS review_items, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS parse_failures""",
}

# ---------------------------------------------------------------- files

FILES = f"""
lined AS (
  SELECT *, k // 1000 AS book, row_number() OVER (PARTITION BY account, k // 1000 ORDER BY k) + 1 AS line_no FROM judged
), good AS (
  SELECT account, book, line_no, k, CAST(strptime(d, '%d/%m/%Y') AS DATE) AS date, descr AS description, CAST(nullif(replace(a, ',', '.'), '') AS DECIMAL(18,2)) AS debit, CAST(nullif(replace(b, ',', '.'), '') AS DECIMAL(18,2)) AS credit
  FROM lined WHERE reason IS NULL
), ids AS (
  SELECT *, coalesce(debit, credit) AS amount, sha256(account || '|' || strftime(date, '%Y-%m-%d') || '|' || CAST(coalesce(debit, credit) AS VARCHAR) || '|' || {NORM.format('description')}) AS txn_id FROM good
), filed AS (
  SELECT *, row_number() OVER (PARTITION BY account, book, txn_id ORDER BY k) - 1 AS occurrence FROM ids
)"""

BOOKS = f"""WITH {SALES}, {TXNS} SELECT account || '/' || CAST(seq // 1000 AS VARCHAR) AS file, strftime(date, '%Y-%m') AS sheet, row_number() OVER (PARTITION BY account, seq // 1000, strftime(date, '%Y-%m') ORDER BY seq) + 1 AS row,
      strftime(date, '%Y-%m-%d') AS date, description, coalesce(CAST(debit AS VARCHAR), '') AS debit, coalesce(CAST(credit AS VARCHAR), '') AS credit, account, '' AS category, txn_id, CAST(0 AS BIGINT) AS occurrence,
      '' AS document, '' AS archived_path, '' AS match_status, '' AS confidence, '2026-01-01T00:00:00' AS imported_at FROM txns"""

ORACLE |= {
    "scan_files": f"""WITH {SALES}, b AS (SELECT DISTINCT account, k // 1000 AS book FROM sales)
      SELECT account, book, 'statement' AS class, row_number() OVER (ORDER BY account, CAST(book AS VARCHAR)) AS file_ord FROM b""",
    "csv_headers": f"WITH {SALES} SELECT DISTINCT account, k // 1000 AS book, ';' AS delimiter, 'date,description,debit,credit' AS header FROM sales",
    "csv_files_to_txns": f"WITH {SALES}, {RAW}, {FILES} SELECT account, book, line_no, date, description, debit, credit, amount, txn_id, occurrence FROM filed",
    "csv_files_failures": f"WITH {SALES}, {RAW}, {FILES} SELECT account, book, line_no, reason FROM lined WHERE reason IS NOT NULL",
    "stream_ledger": f"""WITH {SALES}, {RAW}, {FILES} SELECT DISTINCT account, strftime(date, '%Y-%m') AS month, txn_id, occurrence, strftime(date, '%Y-%m-%d') AS date, description, amount, '2026-01-01T00:00:00' AS imported_at FROM filed""",
    "pdf_files_to_txns": ORACLE["pdf_lines_to_txns"],
    "document_files": f"""WITH {SALES}, {DOCS}, r AS (SELECT *, doc_ord % 11 = 0 AS is_image, doc_ord % 13 = 0 AND doc_ord % 11 <> 0 AS broken FROM docs)
      SELECT doc_ord, is_image, CASE WHEN broken OR date IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount, CASE WHEN NOT broken THEN date END AS date,
      CASE WHEN NOT broken THEN coalesce(vendor, 'Total: ' || replace(CAST(amount AS VARCHAR), '.', ',') || ' EUR') END AS vendor, is_image OR broken OR date IS NULL AS needs_ocr FROM r""",
    "ledger_xlsx": BOOKS,
    "ledger_ods": BOOKS,
    "ledger_keys": f"""WITH {SALES}, r AS (
      SELECT account, CAST(k % 500 AS VARCHAR) AS txn_id, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS occurrence, strftime(dt, '%Y-%m') AS sheet, k FROM sales WHERE k % 13 <> 0 AND k % 17 <> 0
    ) SELECT account, txn_id, CAST(occurrence AS BIGINT) AS occurrence, arg_max(sheet, k) AS sheet, max(k) AS row FROM r GROUP BY ALL""",
}

#: What the batch run matches: the rows of the files, an id for each occurrence, and what the documents' files say.
BATCH = f"""{SALES}, {RAW}, {FILES}, {DOCS.replace('docs AS', 'made AS')}, txns AS (
  SELECT account, txn_id || '#' || CAST(occurrence AS VARCHAR) AS txn_id, date, description, amount, k AS seq FROM filed
), docs AS (
  SELECT source_path, doc_ord, CASE WHEN doc_ord % 13 <> 0 THEN date END AS date, CASE WHEN doc_ord % 13 = 0 OR date IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount,
         CASE WHEN doc_ord % 13 <> 0 THEN coalesce(vendor, 'Total: ' || replace(CAST(amount AS VARCHAR), '.', ',') || ' EUR') END AS vendor, doc_ord % 13 = 0 OR date IS NULL AS needs_ocr
  FROM made
), {outcome()}, put AS (
  SELECT l.*, 'archive/' || strftime(d.date, '%Y/%m/%Y-%m-%d') || '_' || CAST(d.amount AS VARCHAR) || '_' || regexp_replace(regexp_replace(regexp_replace(lower(d.vendor), '[^\\pL\\pN_]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') || '.pdf' AS target
  FROM links l JOIN docs d ON d.doc_ord = l.doc_ord
)"""

ORACLE |= {
    "batch_ledger": f"""WITH {BATCH}, keys AS (
      SELECT DISTINCT account, txn_id, occurrence, date, description, amount FROM filed
    ) SELECT k.account, strftime(k.date, '%Y-%m') AS sheet, k.txn_id, k.occurrence, strftime(k.date, '%Y-%m-%d') AS date, k.description, k.amount, CASE WHEN p.target IS NULL THEN '' ELSE 'matched' END AS match_status,
      coalesce(p.target, '') AS archived_path, round(p.confidence, 6) AS confidence, '2026-01-01T00:00:00' AS imported_at FROM keys k LEFT JOIN put p ON p.account = k.account AND p.txn_id = k.txn_id || '#' || CAST(k.occurrence AS VARCHAR)""",
    "batch_archive": f"WITH {BATCH} SELECT DISTINCT target FROM put",
    "batch_report": f"""WITH {BATCH} SELECT (SELECT count(*) FROM (SELECT DISTINCT account, txn_id, occurrence FROM filed)) AS rows_added, CAST(0 AS BIGINT) AS rows_updated, (SELECT count(*) FROM links) AS docs_matched,
      (SELECT count(*) FROM links) AS docs_copied, (SELECT count(*) FROM review) AS review_items, CAST(1 AS BIGINT) AS unrouted, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS parse_failures""",
}
