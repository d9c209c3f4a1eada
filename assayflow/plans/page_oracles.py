"""The queries of ``page_queries`` as SQL for DuckDB, over views of the same tables."""

from __future__ import annotations

from assayflow.functions import text as T
from assayflow.plans.oracles import FLAGGED, OBS, ORACLE_SQL as FIRST, PARSED, REASONS, SPEC, _list, _pattern, _rows, _score
from assayflow.plans.page_queries import FAULTS, MARKS, UNIT_CACHE, VARIANT_UNITS, U
from assayflow.plans.queries import NAME_CACHE

PAGES = """page AS (SELECT DISTINCT conv_id, turn // 2 AS p FROM conversations),
    pg AS (SELECT *, 'c' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' 2022-12-31' ELSE '' END AS stem, (conv_id + p) % 11 = 0 AS failed, (conv_id + p) % 11 = 0 AND conv_id % 2 = 0 AS bare,
        CASE (conv_id + p) % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN NULL ELSE CASE WHEN conv_id % 3 = 0 THEN '2023-01-09' END END AS own FROM page),
    dated AS (SELECT pg.*, d, dp FROM pg LEFT JOIN (SELECT conv_id, arg_min(own, p) AS d, min(p) AS dp FROM pg WHERE own IS NOT NULL GROUP BY 1) f ON pg.conv_id = f.conv_id),
    res AS (SELECT conv_id, turn // 2 AS p, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn, role, length(text)) - 1 AS i FROM conversations),
    rr AS (SELECT g.stem || '.pdf' AS source_file, g.stem, g.p + 1 AS page_number, r.i AS result_index, g.failed, turn, role, n,
        coalesce(d, CASE WHEN g.conv_id % 2 = 0 THEN '2022-12-31' END) AS date, coalesce(CASE WHEN g.p >= dp THEN d END, CASE WHEN g.conv_id % 2 = 0 THEN '2022-12-31' END) AS forward,
        CASE WHEN turn % 7 = 5 THEN 'raw_value: 1' ELSE role || ' ' || (n % 9) END AS raw_lab_name, CASE WHEN n % 4 > 0 THEN CAST(n AS VARCHAR) END AS raw_value,
        CASE WHEN turn % 3 = 0 THEN 'accepted' WHEN turn % 3 = 1 THEN 'rejected' END AS status FROM dated g JOIN res r ON g.conv_id = r.conv_id AND g.p = r.p WHERE NOT bare)"""
BOXES = (
    PAGES
    + """,
    bx AS (SELECT g.stem, g.p + 1 AS page, g.failed, g.bare, bool_or(n % 2 = 1) AS broken, count(*) FILTER (n % 6 = 0) AS narrow, max(n % 500) FILTER (n % 6 = 0) - min(n % 500) FILTER (n % 6 = 0) AS gap
        FROM pg g JOIN res r ON g.conv_id = r.conv_id AND g.p = r.p GROUP BY ALL),
    box AS (SELECT *, narrow = 1 OR narrow >= 3 OR coalesce(narrow = 2 AND gap <= 30, false) AS columns_ FROM bx)"""
)
_WORD = "CASE l_orderkey % 10 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 9 THEN 1 END"
URINE = (
    PARSED
    + f""",
    urine AS (SELECT raw_value, l_orderkey, l_linenumber, [{_list((U + 'Sediment - Leukocytes', U + 'Sediment - Crystals', U + 'Glucose', 'Blood - HIV'))}][l_linenumber % 4 + 1] AS lab,
        ['Sedimento', 'TIPO II', '', 'Elementos anormais'][l_orderkey % 4 + 1] AS section, CASE l_returnflag WHEN 'A' THEN '/uL' WHEN 'N' THEN 'boolean' END AS unit,
        CASE WHEN l_orderkey % 6 = 0 THEN 1 END AS comment, {_WORD} AS word, parsed_value AS v FROM parsed)"""
)
_SUM = "SELECT lab AS lab_name_standardized, unit AS lab_unit_standardized, count(*) AS n, count(v) AS n_values, sum(CAST(v AS DECIMAL(20, 3))) AS total FROM x GROUP BY ALL"
RANGED = """r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'MG/dl' ELSE '' END AS unit, CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 70 END AS DOUBLE) AS low,
    CAST(CASE WHEN o_custkey % 5 > 1 THEN o_custkey % 90 END AS DOUBLE) AS high, CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 80) + 0.5 END::DOUBLE AS val FROM orders)"""
REQUESTS = """asked AS (SELECT event_id, 'd' || (user_id % 50) AS s, CAST(event_id % 4 AS BIGINT) AS p, CASE event_id % 6 WHEN 5 THEN -1 WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE event_id % 9 END AS i, event_id % 17 > 0 AND event_id % 13 > 0 AS good,
        CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'reject' WHEN 'error' THEN 'missing_row' WHEN 'signup' THEN 'clear' END AS action FROM events),
    size AS (SELECT 'd' || (id % 50) AS s, id // 50 AS p, id % 7 AS n FROM range(150) t(id)),
    judged AS (SELECT event_id, CASE WHEN good THEN a.s END AS source_file, CASE WHEN good THEN a.p END AS page_number, CASE WHEN good THEN CAST(i AS BIGINT) END AS result_index, action,
        CASE WHEN NOT good THEN 'no row' WHEN action IS NULL THEN 'unknown action' WHEN n IS NULL THEN 'no such page' WHEN NOT (i >= 0 AND i < n) THEN 'out of range' END AS refused
        FROM asked a LEFT JOIN size z ON good AND a.s = z.s AND a.p = z.p)"""
SUMMARY = FLAGGED + """, st AS (SELECT *, CASE WHEN doc % 3 = 0 THEN 'accepted' ELSE nullif(review_status, '') END AS s FROM flagged),
    summed AS (SELECT source_file, count(*) AS total, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s IS NULL) AS pending, count(*) FILTER (doc % 5 = 0 AND k = 1) AS markers FROM st GROUP BY 1)"""
_RESTART = "concat_ws(', ', CASE WHEN pending > 0 THEN pending || ' pending row(s)' END, CASE WHEN markers > 0 THEN markers || ' unresolved missing-row marker(s)' END)"


PART_SPECS = """s AS (SELECT 'Blood - ' || p_name || ' ' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN ' (Qualitative)' ELSE '' END AS lab, p_size,
    CASE WHEN p_partkey % 5 < 2 THEN 'boolean' WHEN p_partkey % 7 > 0 THEN p_type END AS unit, CASE WHEN p_partkey % 4 > 0 THEN p_size || '-' || (p_partkey % 10) END AS code,
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS other FROM part)"""


def _published(accepted: str) -> str:
    """One row of each date and lab: the first in the primary unit, or else the first."""
    return f"""WITH r AS (SELECT CAST(ts AS DATE) AS date, 'Blood - ' || event_type AS lab_name, CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) AS v, CASE WHEN event_id % 3 = 0 THEN 'mg/dL' ELSE 'g/L' END AS unit,
            CASE event_type WHEN 'view' THEN 'mg/dL' ELSE 'g/L' END AS lab_unit, 'd' || (user_id % 40) || '.pdf' AS source_file, event_id AS result_index
            FROM events WHERE event_type IN ('view', 'click') AND {accepted}),
        n AS (SELECT *, row_number() OVER (PARTITION BY date, lab_name ORDER BY CASE WHEN unit = lab_unit THEN 0 ELSE 1 END, source_file, result_index) AS i FROM r)
        SELECT date, lab_name, CASE WHEN unit = lab_unit THEN v WHEN lab_unit = 'mg/dL' THEN v * 100 ELSE v * 0.01 END AS value, lab_unit, source_file, result_index FROM n WHERE i = 1"""


def _escape(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


ORACLE_SQL: dict[str, str] = {
    # pages
    "page_rows": f"""WITH {PAGES} SELECT source_file, page_number, result_index, date, raw_lab_name, raw_value, CASE WHEN n % 2 = 0 THEN CAST(n % 500 AS DOUBLE) END AS bbox_left,
        failed OR n % 5 = 0 AS review_needed, CASE WHEN failed THEN 'EXTRACTION_FAILED; ' ELSE '' END AS review_reason FROM rr""",
    "page_rows_forward": f"WITH {PAGES} SELECT source_file, page_number, result_index, forward AS date FROM rr WHERE status = 'accepted'",
    "flatten_array_rows": f"WITH {PAGES} SELECT source_file, count(*) AS n, max(result_index) AS last, count(raw_value) AS n_values FROM rr GROUP BY 1",
    "document_date_fill": f"WITH {PAGES} SELECT DISTINCT source_file, date FROM rr",
    "page_repair": """WITH c AS (SELECT conv_id, turn // 2 AS p, turn, role, length(text) AS n, (length(text) + turn) % 8 AS k FROM conversations),
        e AS (SELECT c.*, j FROM c, range(2) AS o(j) WHERE k <> 7 AND (j = 0 OR k = 5) AND NOT ((conv_id + p) % 4 = 3 AND conv_id % 5 = 0))
        SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id, p ORDER BY turn, role, n, j) - 1 AS i, role || ' ' || (n % 9) AS raw_lab_name, CAST(n AS VARCHAR) AS raw_value, n % 50 + 0.5::DOUBLE AS raw_reference_min FROM e""",
    "page_failures": f"WITH {PAGES} SELECT stem || ' page ' || (p + 1) AS page, CASE WHEN p % 2 = 0 THEN 'unreadable' ELSE 'unknown' END AS reason FROM pg WHERE failed",
    "page_markers": f"WITH {PAGES} SELECT stem || '.pdf' AS source_file, p + 1 AS page_number, p AS anchor_result_index FROM pg WHERE conv_id % 5 = 0",
    "page_reuse": f"WITH {BOXES} SELECT stem, bool_and(NOT failed AND NOT broken AND NOT columns_) AS reusable FROM box GROUP BY 1",
    "page_fallback": f"WITH {BOXES} SELECT stem, page, failed AS again, CASE WHEN bare THEN NULL WHEN broken THEN 'incomplete boxes' WHEN columns_ THEN 'column-like boxes' END AS malformed FROM box",
    "page_salvage": f"WITH {PAGES} SELECT g.stem, g.p + 1 AS page, count(*) FILTER (NOT bare AND turn % 7 <> 5) AS n FROM pg g JOIN res r ON g.conv_id = r.conv_id AND g.p = r.p GROUP BY ALL",
    "page_placeholder": f"""WITH {PAGES} SELECT stem || '.pdf' AS source_file, p + 1 AS page_number, 0 AS result_index, CASE WHEN p % 2 = 0 THEN 'unreadable' ELSE 'Unknown extraction failure' END AS raw_comments, 'EXTRACTION_FAILED; ' AS review_reason FROM pg WHERE bare""",
    "page_null_values": f"WITH {PAGES}, s AS (SELECT stem, page_number AS page, count(*) FILTER (raw_value IS NULL) / count(*) AS x FROM rr GROUP BY ALL) SELECT stem, page, round(x, 6) AS null_share FROM s WHERE x > 0.5",
    "page_renames": f"WITH {PAGES} SELECT stem, count(raw_value) AS n_values, count(*) FILTER (n % 2 = 0) AS n_boxes FROM rr GROUP BY 1",
    "page_targets": f"""WITH {PAGES}, dir AS (SELECT stem, stem || CASE WHEN bool_or(p % 2 = 0) THEN '_0a1b2c3d' ELSE '_FFFFFFFF' END AS d FROM pg GROUP BY 1)
        SELECT CASE WHEN result_index = 1 THEN 'other.pdf' ELSE source_file END AS source_file, CASE WHEN result_index <> 1 THEN d || '/' || rr.stem || '.' || lpad(CAST(page_number AS VARCHAR), 3, '0') || '.json' END AS target, count(*) AS n
        FROM rr JOIN dir ON rr.stem = dir.stem GROUP BY ALL""",
    "page_status_backfill": f"""WITH {PAGES} SELECT a.source_file, a.page_number, a.result_index + a.page_number % 2 AS result_index, b.status AS review_status
        FROM rr a LEFT JOIN rr b ON a.source_file = b.source_file AND a.page_number = b.page_number AND a.result_index + a.page_number % 2 = b.result_index""",
    "page_artifacts": f"""WITH {PAGES} SELECT rtrim(translate(base64(encode('{{"page_number": ' || page_number || ', "result_index": ' || result_index || ', "source_file": "' || source_file || '"}}')), '+/', '-_'), '=') AS row_id,
        source_file, result_index, CASE WHEN n % 2 = 0 THEN CAST(round_even((n % 500) * 1700.0 / 1000, 0) AS BIGINT) END AS "left", CASE WHEN n % 2 = 0 THEN 880 END AS bottom, raw_value FROM rr""",
    "snapshot_split": f"WITH {BOXES} SELECT stem, NOT (length(stem) % 2 = 0 AND bool_and(NOT failed AND NOT broken AND NOT columns_)) AS todo FROM box GROUP BY stem",
    "union_by_name": FIRST["union_by_name"],
    "snapshot_merge": """SELECT s_name, CASE WHEN s_nationkey % 3 <> 1 THEN CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS acct,
        CASE WHEN s_nationkey % 3 <> 2 THEN s_name || ', "x"' || chr(10) || 'next' END AS note FROM supplier""",
    "snapshot_audit": "SELECT 'n' || s_nationkey AS path, count(*) AS n_rows, count(*) FILTER (s_suppkey % 17 = 0) AS n_malformed FROM supplier GROUP BY s_nationkey",
    "whole_export": _published("event_id % 4 > 0"),
    "incremental_export": _published("CASE user_id % 40 WHEN 3 THEN true WHEN 7 THEN event_id % 3 = 0 ELSE event_id % 4 > 0 END"),
    "percent_ambiguity": f"WITH {OBS} SELECT row_seq, lab_name AS lab_name_standardized FROM obs WHERE lab_name = 'Blood - purchase' AND coalesce(lab_unit, '') <> 'mg/dL' AND coalesce(k <> 1, true)",
    "ledger_new": """WITH f AS (SELECT page_id, CAST(page_id AS VARCHAR) AS path, sha256(html) AS content_hash FROM pages)
        SELECT content_hash, min(path) AS path FROM f WHERE page_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM f WHERE page_id % 2 = 0) GROUP BY content_hash""",
    "stale_difference": FIRST["stale_difference"],
    "categorize_rules": FIRST["categorize_rules"],
    "regression_canonical": '''SELECT coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '') || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || ',""' || '"' ELSE o_orderpriority END || ','
        || CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END ELSE '' END || ',' || o_orderkey AS line FROM orders''',
    "approved_case_faults": """WITH c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN doc_id % 7 > 0 THEN source || (doc_id % 40) END AS stem, lang FROM documents)
        SELECT case_id, 'missing required files: expected.csv' AS fault FROM c WHERE doc_id % 13 = 0
        UNION ALL SELECT case_id, 'incomplete metadata' FROM c WHERE doc_id % 13 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR trim(coalesce(lang, '')) = '')
        UNION ALL SELECT case_id, 'stem repeats: ' || stem FROM c WHERE stem IN (SELECT stem FROM c GROUP BY stem HAVING count(*) > 1)""",
    # variants
    "variant_units": f"""WITH {OBS}, r AS (SELECT CASE row_seq % 3 WHEN 0 THEN 'Blood - purchase' WHEN 1 THEN 'Blood - purchase (%)' ELSE 'Blood - view' END AS lab, [{_list(VARIANT_UNITS)}][row_seq % {len(VARIANT_UNITS)} + 1] AS unit FROM obs),
        e AS (SELECT *, lab <> 'Blood - view' AS pair, unit IN ('%', 'percent') AS share FROM r)
        SELECT lab AS lab_name_standardized, unit AS raw_lab_unit, CASE WHEN NOT pair OR unit = ' ' THEN lab WHEN share THEN 'Blood - purchase (%)' WHEN unit = 'odd' THEN lab ELSE 'Blood - purchase' END AS effective_lab,
            CASE WHEN NOT pair OR unit = ' ' THEN 'U' WHEN share THEN '%' ELSE 'mg/dL' END AS lab_unit_standardized, count(*) AS n FROM e GROUP BY ALL""",
    "missing_unit_from_range": f"""WITH {RANGED}, s AS (SELECT *, {_score('low', 'high', 'val', '2.0', '9.0')} AS a, {_score('low', 'high', 'val', '20.0', '75.0')} AS b FROM r)
        SELECT o_orderkey, CASE WHEN trim(coalesce(unit, '')) <> '' THEN 'U' WHEN b - a >= 0.25 THEN 'mg/dL' WHEN a - b >= 0.25 THEN '%' ELSE 'U' END AS lab_unit_standardized FROM s""",
    "complement_variants": f"""WITH {RANGED}, s AS (SELECT *, {_score('low', 'high', 'val', '50.0', '90.0')} AS a, {_score('low', 'high', 'val', '10.0', '40.0')} AS b FROM r),
        t AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 AND unit = 'MG/dl' THEN CASE WHEN b - a >= 0.25 THEN 3 WHEN a - b >= 0.25 THEN 4 END END AS pick FROM s)
        SELECT o_orderkey, CASE pick WHEN 3 THEN 'Blood - Complement C3' WHEN 4 THEN 'Blood - Complement C4' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Blood - Complement CH50' ELSE 'Blood - purchase' END END AS lab_name_standardized,
            CASE pick WHEN 3 THEN 'mg/dL' WHEN 4 THEN 'g/L' ELSE 'U' END AS lab_unit_standardized FROM t""",
    # normalisation
    "sediment_units": f"""WITH {URINE}, f AS (SELECT lab, v, CASE WHEN contains(lab, 'Sediment') AND unit = '/uL' AND section = 'Sedimento' AND (contains(raw_value, '/campo') OR v IS NULL) THEN '/campo' ELSE unit END AS unit FROM urine),
        x AS (SELECT CASE WHEN unit = '/uL' AND contains(lab, 'Leukocytes') THEN lab || ' (Absolute)' ELSE lab END AS lab, unit, v FROM f) {_SUM}""",
    "qualitative_rows": f"""WITH {URINE}, h AS (SELECT *, contains(lab, 'Glucose') AND v IS NULL AND word IS NOT NULL AS hit FROM urine),
        x AS (SELECT CASE WHEN hit THEN lab || ' (Qualitative)' ELSE lab END AS lab, CASE WHEN hit THEN 'boolean' ELSE unit END AS unit, CASE WHEN hit THEN word ELSE v END AS v FROM h) {_SUM}""",
    "strip_values": f"""WITH {URINE}, h AS (SELECT *, contains(lab, 'Glucose') AND v IS NOT NULL AND section IN ('TIPO II', 'Elementos anormais') AS hit FROM urine),
        x AS (SELECT CASE WHEN hit THEN lab || ' (Qualitative)' ELSE lab END AS lab, CASE WHEN hit THEN 'boolean' ELSE unit END AS unit, CASE WHEN hit THEN CASE WHEN v <= 0 THEN 0 ELSE 1 END ELSE v END AS v FROM h) {_SUM}""",
    "qualitative_values": f"""WITH {URINE}, x AS (SELECT lab, unit, CASE WHEN lab = 'Blood - HIV' OR coalesce(unit = 'boolean', false) THEN coalesce(comment, v, word) WHEN v IS NULL AND coalesce(word, comment) = 0 THEN 0.0 ELSE v END AS v FROM urine) {_SUM}""",
    "qualitative_aliases": f"""WITH {URINE}, l AS (SELECT *, CASE WHEN l_linenumber = 2 THEN '{U}Glucose (Qualitative)' ELSE lab END AS l2, l_orderkey % 3 = 0 AS given FROM urine)
        SELECT CASE WHEN NOT given AND l2 = 'Blood - HIV' AND word IS NOT NULL THEN 'Blood - HIV (Qualitative)' WHEN given AND contains(l2, '(Qualitative)') THEN '{U}Glucose' ELSE l2 END AS lab_name_standardized,
            CASE WHEN given THEN 'mg/dL' END AS raw_lab_unit, count(*) AS n FROM l GROUP BY ALL""",
    # specifications
    "spec_aliases": f"""WITH {PART_SPECS}, a AS (SELECT lab AS alias, lab, code, 0 AS rank FROM s UNION ALL SELECT CASE WHEN ends_with(lab, ' (Qualitative)') THEN replace(lab, ' (Qualitative)', '') ELSE lab || ' (Qualitative)' END, lab, code, 1 FROM s WHERE unit = 'boolean'),
        f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY rank, lab) = 1) SELECT alias, lab AS lab_name, code AS loinc_code FROM f WHERE code IS NOT NULL""",
    "spec_units": f"WITH {PART_SPECS} SELECT 'unit' AS kind, unit AS name FROM (SELECT unit FROM s UNION SELECT other FROM s) WHERE unit IS NOT NULL UNION ALL SELECT 'lab', lab FROM s",
    "spec_factors": f"WITH {PART_SPECS} SELECT lab AS lab_name, unit, 1.0::DOUBLE AS factor FROM s WHERE unit IS NOT NULL UNION ALL SELECT lab, other, p_size::DOUBLE FROM s WHERE other IS DISTINCT FROM unit",
    "unconverted_units": f"""WITH {OBS}, r AS (SELECT CASE WHEN row_seq % 9 = 0 THEN '$UNKNOWN$' ELSE lab_name END AS lab, CASE WHEN row_seq % 5 = 0 THEN '%' ELSE lab_unit END AS unit FROM obs)
        SELECT lab AS lab_name, unit, count(*) AS n FROM r WHERE lab <> '$UNKNOWN$' AND unit IS NOT NULL AND NOT (lab IN ('Blood - view', 'Blood - click') AND unit <> '%') AND NOT (lab = 'Blood - purchase' AND unit = 'mg/dL') GROUP BY ALL""",
    "repeated_codes": f"WITH {PART_SPECS} SELECT code AS loinc_code, string_agg(lab, '|' ORDER BY lab) AS labs FROM s WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    # caches
    "missing_names": f"""WITH cache(key, v) AS (VALUES {_rows(NAME_CACHE)}), r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS name,
            CASE WHEN c_nationkey % 4 = 0 THEN 'Seccao 0' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Section ' || (c_nationkey % 4) END AS section FROM customer),
        k AS (SELECT *, lower(name) || coalesce('|' || lower(section), '') AS key FROM r)
        SELECT key, name AS raw_lab_name, section AS raw_section_name FROM k WHERE key NOT IN (SELECT key FROM cache) QUALIFY row_number() OVER (PARTITION BY key ORDER BY c_custkey) = 1""",
    "missing_units": f"""WITH found AS ({FIRST['name_cache_lookup']}), uc(key, v) AS (VALUES {_rows(UNIT_CACHE)}),
        r AS (SELECT CASE c_custkey % 3 WHEN 0 THEN ' Mg/L' WHEN 1 THEN 'g' ELSE '' END AS unit, lab_name_standardized AS lab FROM customer c JOIN found f ON f.raw_lab_name = c_mktsegment
            AND f.raw_section_name IS NOT DISTINCT FROM CASE WHEN c_nationkey % 4 = 0 THEN 'Seccao 0' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Section ' || (c_nationkey % 4) END WHERE lab_name_standardized <> '$UNKNOWN$'),
        k AS (SELECT *, CASE WHEN unit = '' THEN 'null' ELSE lower(trim(unit)) END || '|' || lower(lab) AS key FROM r)
        SELECT key, min(unit) AS raw_unit, min(lab) AS lab_name FROM k WHERE key NOT IN (SELECT key FROM uc) GROUP BY key""",
    "pruned_units": """WITH c AS (SELECT DISTINCT lower(p_brand) || CASE WHEN p_size % 3 > 0 THEN '|' ELSE '' END || CASE WHEN p_size % 4 > 0 THEN lower(p_type) ELSE '' END AS key, CASE WHEN p_size % 5 = 0 THEN '$UNKNOWN$' ELSE 'u' END AS unit FROM part)
        SELECT key, unit FROM c WHERE unit <> '$UNKNOWN$' AND contains(key, '|') AND NOT ends_with(key, '|')""",
    "accepted_answers": "SELECT lower(p_brand) AS key, min('L' || (p_size % 7)) AS lab_name FROM part WHERE lower(p_brand) LIKE '%3%' AND p_size % 7 IN (1, 3) GROUP BY 1",
    "unknown_report": f"""WITH {OBS}, r AS (SELECT row_seq % 7 = 0 OR row_seq % 5 = 0 AS unknown, CASE WHEN row_seq % 11 > 0 THEN lab_name END AS lab, lab_unit, CASE WHEN k > 4 THEN 'blood' ELSE 'urine' END AS lab_type FROM obs)
        SELECT lab AS raw_lab_name, lab_unit AS raw_lab_unit, lab_type, count(*) AS n FROM r WHERE unknown AND lab IS NOT NULL GROUP BY ALL""",
    "unknown_shares": f"""WITH {OBS} SELECT round(avg(CAST(row_seq % 7 = 0 AS INT)), 9) AS unknown_labs, round(avg(CAST(row_seq % 5 = 0 AS INT)), 9) AS unknown_units,
        count(DISTINCT lab_name) FILTER (row_seq % 7 = 0) AS distinct_labs, count(DISTINCT lab_unit) FILTER (row_seq % 5 = 0) AS distinct_units FROM obs""",
    "corpus_counts": f"""WITH {FLAGGED} SELECT 'document' AS kind, source_file AS name, count(*) AS n FROM flagged GROUP BY ALL UNION ALL SELECT 'status', coalesce(nullif(review_status, ''), 'pending'), count(*) FROM flagged GROUP BY ALL
        UNION ALL SELECT 'reason', x, count(*) FROM (SELECT trim(unnest(string_split(review_reason, ';'))) AS x FROM flagged) WHERE x <> '' GROUP BY ALL""",
    "corpus_rollup": f"""WITH {FLAGGED}, c AS (SELECT source_file, 'rows' AS kind, 'all' AS name FROM flagged UNION ALL SELECT source_file, 'status', coalesce(nullif(review_status, ''), 'pending') FROM flagged
        UNION ALL SELECT source_file, 'reason', x FROM (SELECT source_file, trim(unnest(string_split(review_reason, ';'))) AS x FROM flagged) WHERE x <> '')
        SELECT kind, name, source_file, count(*) AS n, grouping(source_file) = 1 AS whole FROM c GROUP BY GROUPING SETS ((kind, name), (kind, name, source_file))""",
    "batch_flags": f'WITH {OBS} SELECT row_seq, coalesce(value > 60, false) AS "HIGH", coalesce(k = 3, false) AS "THREE" FROM obs',
    # review work
    "judged_requests": f"WITH {REQUESTS} SELECT * FROM judged",
    "decision_log": f"""WITH {REQUESTS} SELECT source_file, page_number, result_index, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'clear' THEN '' END AS status,
        strftime(make_timestamp(event_id * 100 * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS decided_at FROM judged WHERE refused IS NULL""",
    "unready_documents": f"WITH {SUMMARY} SELECT source_file, {_RESTART} AS issue FROM summed WHERE pending > 0 OR markers > 0",
    "document_choices": f"""WITH {SUMMARY} SELECT source_file, source_file || ' (pending ' || pending || ', rejected ' || rejected || ', missing ' || markers || ', reviewed ' || (accepted + rejected) || '/' || total || ')' AS label,
        false AS fixture_ready, pending FROM summed WHERE pending > 0 OR markers > 0""",
    "ready_documents": f"WITH {SUMMARY} SELECT source_file, accepted + rejected AS reviewed FROM summed WHERE pending = 0 AND markers = 0",
    "initial_document": f"""WITH {FLAGGED}, s AS (SELECT source_file, count(*) FILTER (value > 50) AS b, count(*) FILTER (review_needed) AS q, count(*) FILTER (coalesce(review_status, '') = '') AS u, count(*) AS n FROM flagged GROUP BY 1)
        SELECT source_file FROM s ORDER BY b DESC, q DESC, u DESC, n DESC, source_file LIMIT 1""",
    "next_in_corpus": f"""WITH {FLAGGED}, w AS (SELECT source_file, page_number, result_index, review_needed, row_number() OVER (ORDER BY source_file, page_number, result_index) AS a,
            row_number() OVER (PARTITION BY review_needed ORDER BY source_file, page_number, result_index) AS b FROM flagged WHERE coalesce(review_status, '') = '')
        SELECT source_file, page_number, result_index, false AS needed FROM w WHERE a = 1 UNION ALL SELECT source_file, page_number, result_index, true FROM w WHERE review_needed AND b = 1""",
    "row_moves": f"""WITH {FLAGGED}, v AS (SELECT row_seq, row_number() OVER (PARTITION BY source_file ORDER BY page_number, result_index, lab_name) - 1 AS position, count(*) OVER (PARTITION BY source_file) - 1 AS last FROM flagged)
        SELECT row_seq, position, greatest(position - 1, 0) AS previous, least(position + 1, last) AS next FROM v""",
    "resolved_position": f"""WITH {OBS}, v AS (SELECT row_seq, row_number() OVER (ORDER BY row_seq) AS i, count(*) OVER () AS n FROM obs WHERE lab_name = 'Blood - view')
        SELECT 'none' AS kind, 0 AS position UNION ALL SELECT DISTINCT 'end', n - 1 FROM v UNION ALL SELECT 'empty tokens', 0 UNION ALL SELECT 'selected', row_seq FROM v WHERE i = 4""",
    "queue_display": f"""WITH {FLAGGED}, q AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_number, result_index) - 1 AS position FROM flagged WHERE coalesce(review_status, '') = '')
        SELECT source_file, position, CASE WHEN position = 2 THEN '->' ELSE '' END AS current, 'P' AS status_code, CAST(page_number AS VARCHAR) AS page_number, CAST(result_index AS VARCHAR) AS result_index,
            '&lt;' || lab_name || '&gt;&amp;' AS raw_lab_name, CASE WHEN k > 2 THEN 'a&#x27;b&quot;' ELSE '-' END AS raw_value, lab_name FROM q""",
    "row_context": f"""WITH {OBS}, v AS (SELECT *, row_number() OVER (ORDER BY row_seq) - 1 AS position, count(*) OVER () AS n FROM obs WHERE lab_name = 'Blood - click')
        SELECT position, 'Row ' || (position + 1) || ' of ' || n AS position_text, CASE WHEN k > 4 THEN 1.5 END AS "min", CASE WHEN k % 2 = 0 THEN 9.0 END AS "max", lab_name AS plot_lab FROM v WHERE position IN (0, 4, 11)""",
    "display_table": f"""WITH {FLAGGED} SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN k > 4 THEN '1.0 - 9.0' ELSE '> 1.0' END AS reference_range, CASE review_status WHEN 'accepted' THEN 'Accepted' WHEN 'rejected' THEN 'Rejected' ELSE '' END AS review_status,
        '' AS raw_value, source_file || '.scan' AS source_document, CAST(page_number AS VARCHAR) AS page_number FROM flagged""",
    "lab_choices": f"WITH {OBS} SELECT DISTINCT lab_name FROM obs WHERE row_seq % 4 > 1",
    # functions
    "age_years": """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_custkey AS INT) AS d FROM orders)
        SELECT o_orderkey, year(d) - year(b) - CASE WHEN (month(d), day(d)) < (month(b), day(b)) THEN 1 ELSE 0 END AS age FROM d""",
    "numeric_fields": "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN o_custkey + 0.25 WHEN 2 THEN o_custkey END AS DOUBLE) AS number FROM orders",
    "range_texts": """SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN 1.5 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 0 END WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 1 END WHEN 4 THEN 12 END AS DOUBLE) AS low,
        CAST(CASE o_orderkey % 7 WHEN 0 THEN o_custkey + 5 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 0 END WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 1 END WHEN 4 THEN 12 END AS DOUBLE) AS high FROM orders""",
    "clean_boxes": """WITH w AS (SELECT p_partkey, p_size, p_size % 5 <> 0 AND p_size % 7 <> 0 AS whole FROM part)
        SELECT p_partkey, CASE WHEN whole THEN CAST(p_size AS DOUBLE) END AS "left", CASE WHEN whole THEN 3.5 END AS top, CASE WHEN whole THEN 400.0 END AS "right", CASE WHEN whole THEN 9.25 END AS bottom, whole AS valid FROM w""",
    "text_marks": f"""WITH w AS (SELECT [{_list(MARKS)}][doc_id % {len(MARKS)} + 1] AS word, count(*) AS n FROM documents GROUP BY 1)
        SELECT word, n, regexp_matches(lower(word), {_pattern(inside=T.STRIP_SECTIONS)}) AS strip, contains(lower(word), 'sedimento') AS sediment, contains(word, '%') OR contains(lower(word), 'percent') AS percent,
            regexp_matches(replace(lower(word), ' ', ''), '(^|x)10\\^?(3|9)/') OR regexp_matches(replace(lower(word), ' ', ''), {_pattern(inside=T.ABSOLUTE_COUNT_MARKS)}) AS absolute, regexp_matches(lower(word), {_pattern(inside=T.FIELD_LABELS)}) AS label,
            lower(trim(word)) IN ('', 'nan', 'none', 'null') AS blank, regexp_replace(word, '\\.[^.]*$', '') AS document, nullif(regexp_extract(word, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS day,
            CASE WHEN regexp_full_match(word, '[A-Za-z](\\s+[A-Za-z]){{2,}}') THEN replace(word, ' ', '') ELSE word END AS spaced FROM w""",
    "html_texts": f"""WITH {FLAGGED}, x AS (SELECT CASE WHEN k % 3 = 0 THEN '-' ELSE {_escape("'<a href=''x''>\"' || lab_name || '\" & co</a>'")} END AS html, review_reason, lab_name || ': ' || coalesce(CAST(k AS VARCHAR), '') || ' of {{unknown}}' AS filled, coalesce(nullif(review_status, ''), 'pending') AS status FROM flagged)
        SELECT html, CASE WHEN review_reason = '' THEN '' ELSE '[' || replace(rtrim(review_reason, '; '), '; ', '][') || ']' END AS chips, filled, status, count(*) AS n FROM x GROUP BY ALL""",
    "service_faults": f"""WITH m AS (SELECT [{_list(FAULTS)}][event_id % {len(FAULTS)} + 1] AS message, count(*) AS n FROM events GROUP BY 1), l AS (SELECT *, lower(message) AS low FROM m)
        SELECT message, n, CASE WHEN contains(message, '401') OR contains(message, 'Unauthorized') THEN 'authentication' WHEN contains(message, '403') OR contains(message, 'Forbidden') OR contains(low, 'permission') THEN 'authorization'
            WHEN contains(low, 'timeout') THEN 'timeout' WHEN contains(message, '404') THEN 'not found' WHEN contains(message, '400') OR contains(message, 'BadRequest') OR contains(low, 'invalid') THEN 'rejected'
            WHEN contains(message, 'Connection') OR contains(message, 'getaddrinfo') OR contains(low, 'refused') OR contains(low, 'reset') OR contains(low, 'name or service not known') THEN 'connection' ELSE 'unknown' END AS fault FROM l""",
    "fenced_texts": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"a": ' || doc_id || '}' WHEN 1 THEN ' [' || doc_id || '] ' WHEN 2 THEN '' WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE '{"a": ' || doc_id END AS inner,
        CASE doc_id % 5 WHEN 0 THEN '{"a":' || doc_id || '}' WHEN 1 THEN '[' || doc_id || ']' WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE '[]' END AS json FROM documents""",
    "document_paths": f"""WITH {PAGES}, f AS (SELECT stem, p + 1 AS page, stem || CASE length(stem) % 3 WHEN 0 THEN '_0a1b2C3d' WHEN 1 THEN '_0a1b2c3' ELSE '' END AS folder FROM pg),
        n AS (SELECT *, CASE WHEN page % 2 = 0 THEN 'scan ' || stem || '.1' WHEN length(stem) % 3 = 0 THEN stem ELSE folder END AS s, lpad(CAST(page AS VARCHAR), 3, '0') AS k FROM f)
        SELECT stem, page, 'out/' || folder || '/' || s || '.csv' AS csv, 'out/' || folder || '/' || s || '.' || k || '.json' AS json, 'out/' || folder || '/' || s || '.' || k || '.jpg' AS image FROM n""",
    "legacy_moves": """WITH d AS (SELECT doc_id, 'd' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS stem, substr(sha256(text), 1, 8) AS h FROM documents),
        name AS (SELECT DISTINCT folder FROM (SELECT stem AS folder FROM d WHERE doc_id % 4 IN (0, 2, 3) UNION ALL SELECT stem || '_' || h FROM d WHERE doc_id % 4 IN (1, 2) UNION ALL SELECT stem || 'x' FROM d WHERE doc_id % 4 = 3)),
        one AS (SELECT stem, count(*) AS n, min(h) AS h FROM d WHERE doc_id % 7 > 0 GROUP BY stem)
        SELECT a.folder, CASE WHEN n = 1 THEN a.folder || '_' || h END AS target,
            CASE WHEN regexp_matches(a.folder, '_[0-9a-f]{8}$') THEN 'already_migrated' WHEN n IS DISTINCT FROM 1 THEN 'source_not_found' WHEN b.folder IS NOT NULL THEN 'target_exists' ELSE 'renamed' END AS status
        FROM name a LEFT JOIN one ON a.folder = one.stem LEFT JOIN name b ON b.folder = one.stem || '_' || one.h AND n = 1""",
}
