"""The registered queries as SQL for DuckDB, over views of the same tables."""

from __future__ import annotations

from assayflow.functions import text as T
from assayflow.operators import standardize
from assayflow.plans.queries import AGE_RANGES, NAME_CACHE, SECTION_WORDS, WORDS

OBS = """obs AS (SELECT 'Blood - ' || event_type AS lab_name, CAST(ts AS DATE) AS date, value, user_id AS doc, event_id AS row_seq,
    CASE event_id % 3 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'g/L' END AS lab_unit, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"""
RAW = """line AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q FROM lineitem),
    raw_text AS (SELECT *, CASE l_orderkey % 10 WHEN 0 THEN '<' || q WHEN 1 THEN q || ',5' WHEN 2 THEN q || ' a ' || (q + 2) || '/campo'
        WHEN 3 THEN q || '.6=1946' WHEN 4 THEN 'NEGATIVO' WHEN 5 THEN 'Não detetado' WHEN 6 THEN 'Ca. ' || q WHEN 7 THEN q || ' .0' WHEN 8 THEN q || ' 000'
        WHEN 9 THEN '1+' END AS raw_value FROM line)"""
#: Raw text to numbers, step by step.
PARSED = (
    RAW
    + r""",
    s1 AS (SELECT *, starts_with(trim(raw_value), '<') AS below, starts_with(trim(raw_value), '>') AS above, trim(raw_value) AS t0 FROM raw_text),
    s2 AS (SELECT *, CASE WHEN below OR above THEN trim(split_part(regexp_replace(t0, '^[<>]\s*', ''), '=', 1)) ELSE t0 END AS t1 FROM s1),
    s3 AS (SELECT *, regexp_replace(regexp_replace(t1, '(\d)\s*([.,])\s*(\d)', '\1\2\3', 'g'), '^(?:ca\.?|cerca de|aprox\.?|approximately)\s*', '', 'i') AS t2 FROM s2),
    s4 AS (SELECT *, regexp_replace(CASE WHEN contains(t2, '=') AND NOT ends_with(t2, '=') THEN trim(split_part(t2, '=', 1)) ELSE t2 END, '=+$', '') AS t3 FROM s3),
    s5 AS (SELECT *, replace(CASE WHEN regexp_full_match(t3, '\d[\d\s]+') THEN replace(t3, ' ', '') ELSE t3 END, ',', '.') AS t4 FROM s4),
    s6 AS (SELECT *, TRY_CAST(regexp_extract(t4, '^\s*(\d+(?:\.\d+)?)\s*(?:-|a|A)\s*(\d+(?:\.\d+)?)(?:\s*/.*)?\s*$', 1) AS DOUBLE) AS lo,
        TRY_CAST(regexp_extract(t4, '^\s*(\d+(?:\.\d+)?)\s*(?:-|a|A)\s*(\d+(?:\.\d+)?)(?:\s*/.*)?\s*$', 2) AS DOUBLE) AS hi FROM s5),
    parsed AS (SELECT *, coalesce(CASE WHEN hi >= lo THEN (lo + hi) / 2 END,
        CASE WHEN regexp_full_match(t4, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN TRY_CAST(t4 AS DOUBLE) END) AS parsed_value FROM s6)"""
)
SPEC = """spec(lab_name, primary_unit, loinc_code, bmin, bmax, mdc, rmin, rmax) AS (VALUES
    ('Blood - view', 'mg/dL', '1-1', 0.0, 90.0, 20.0, 10.0, 60.0), ('Blood - click', 'g/L', '2-2', 5.0, 80.0, 10.0, 20.0, NULL),
    ('Blood - error', 'boolean', '3-3', NULL, NULL, 5.0, NULL, NULL), ('Blood - purchase', 'mg/dL', '3-3', NULL, 50.0, 40.0, NULL, 40.0),
    ('Blood - purchase (%)', '%', '5-5', NULL, NULL, NULL, 5.0, 95.0), ('Urine - odd', '%', 'x', 9.0, 3.0, -1.0, NULL, NULL))"""
REASONS = OBS + """, reasons AS (SELECT *, CASE WHEN value > 80 THEN 'IMPOSSIBLE_VALUE; ' ELSE '' END || CASE WHEN k > 5 THEN 'TEMPORAL_ANOMALY; ' ELSE '' END
    || CASE WHEN row_seq % 9 = 0 THEN 'DUPLICATE_ENTRY; ' ELSE '' END AS review_reason FROM obs)"""
FLAGGED = REASONS + """, flagged AS (SELECT *, CASE WHEN k <> 3 THEN value > 70 END AS is_out_of_reference, value > 50 AS is_out_of_optimal_range, review_reason <> '' AS review_needed,
    CASE row_seq % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN '' END AS review_status, CAST(doc AS VARCHAR) AS source_file, row_seq % 5 AS page_number,
    row_seq AS result_index FROM reasons)"""
DECIDED = """decided AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TURNS = f"""turns AS (SELECT CAST(conv_id AS VARCHAR) AS source_file, turn AS result_index, [{', '.join(f"'{w}'" for w in SECTION_WORDS)}][turn % 6 + 1] AS raw_lab_name,
    CASE WHEN turn % 4 = 0 THEN 'given' END AS raw_section_name, role FROM conversations)"""


def _list(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def _pattern(starts=(), whole=(), inside=()) -> str:
    quote = lambda s: "".join("\\" + c if c in r"\.*+?()[]{}|^$" else c for c in s)
    parts = [f"^({'|'.join(map(quote, starts))})"] * bool(starts) + [f"^({'|'.join(map(quote, whole))})$"] * bool(whole) + [f"({'|'.join(map(quote, inside))})"] * bool(inside)
    return "'" + "|".join(parts) + "'"


def _rows(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_FOLD = "strip_accents(lower(trim(raw_value)))"
_SECTION = "CASE WHEN c_nationkey % 4 = 0 THEN 'Seccao 0' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Section ' || (c_nationkey % 4) END"
_SCORE = "CASE WHEN {e} = 0 THEN abs({o}) ELSE abs({o} - {e}) / greatest(abs({e}), 1.0) END"


def _score(low: str, high: str, value: str, emin: str, emax: str) -> str:
    a, b = (f"CASE WHEN {x} IS NOT NULL AND {e} IS NOT NULL THEN {_SCORE.format(o=x, e=e)} END" for x, e in ((low, emin), (high, emax)))
    mid = f"CASE WHEN {emin} IS NOT NULL AND {emax} IS NOT NULL AND {value} IS NOT NULL THEN {_SCORE.format(o=value, e=f'(({emin} + {emax}) / 2)')} END"
    return f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL AND {emin} IS NOT NULL AND {emax} IS NOT NULL THEN (({a}) + ({b})) / 2 ELSE coalesce({a}, {b}, {mid}) END"


_DUPLICATE = """n > 1 AND NOT coalesce(coalesce(b0 = b1, false) AND (coalesce(nv = n AND vmax - vmin <= greatest(0.1, 0.01 * greatest(1.0, greatest(abs(vmin), abs(vmax)))), false)
    OR coalesce(nr = n AND r0 = r1 AND u0 IS NOT DISTINCT FROM u1, false)), false)"""
_GROUPS = OBS + """, lim AS (SELECT *, k % 10 = 0 AS below, 'v' || CAST(floor(value / 10) AS BIGINT) AS raw FROM obs),
    grouped AS (SELECT *, count(*) OVER w AS n, count(value) OVER w AS nv, min(value) OVER w AS vmin, max(value) OVER w AS vmax, min(below) OVER w AS b0, max(below) OVER w AS b1,
        count(raw) OVER w AS nr, min(raw) OVER w AS r0, max(raw) OVER w AS r1, min(lab_unit) OVER w AS u0, max(lab_unit) OVER w AS u1
        FROM lim WINDOW w AS (PARTITION BY doc, date, lab_name))"""
_TEMPORAL = """lagged AS (SELECT o.*, mdc, lag(value) OVER w AS pv, lag(date) OVER w AS pd FROM obs o LEFT JOIN spec s ON o.lab_name = s.lab_name
        WHERE date IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY doc, o.lab_name ORDER BY date, row_seq)),
    jumps AS (SELECT * FROM lagged WHERE date_diff('day', pd, date) > 0 AND abs(value - pv) / date_diff('day', pd, date) > mdc)"""
_DAYS = "lastv AS (SELECT doc, date, lab_name, arg_max(value, row_seq) AS v FROM obs WHERE date IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"
_DIFF = "CASE WHEN {a} <> 0 THEN abs({e} - {a}) / abs({a}) * 100 ELSE abs({e} - {a}) * 100 END"

ORACLE_SQL: dict[str, str] = {
    "number_parse": f"WITH {PARSED} SELECT l_orderkey, l_linenumber, raw_value, parsed_value AS value, below AS is_below, above AS is_above FROM parsed",
    "comparison_flags": f"WITH {PARSED} SELECT below AS is_below, above AS is_above, count(*) AS n FROM parsed GROUP BY ALL",
    "interval_midpoint": rf"""WITH {RAW}, x AS (SELECT *, TRY_CAST(regexp_extract(raw_value, '^\s*(\d+(?:\.\d+)?)\s*(?:-|a)\s*(\d+(?:\.\d+)?)(?:\s*/.*)?\s*$', 1) AS DOUBLE) AS lo,
        TRY_CAST(regexp_extract(raw_value, '^\s*(\d+(?:\.\d+)?)\s*(?:-|a)\s*(\d+(?:\.\d+)?)(?:\s*/.*)?\s*$', 2) AS DOUBLE) AS hi FROM raw_text)
        SELECT l_orderkey, l_linenumber, (lo + hi) / 2 AS midpoint FROM x WHERE hi >= lo""",
    "qualitative_classify": f"""WITH {RAW}, words(raw_value) AS (VALUES {', '.join(f"('{w}')" for w in WORDS)}),
        both_ AS (SELECT raw_value FROM raw_text UNION ALL SELECT raw_value FROM words UNION ALL SELECT source FROM documents),
        grouped AS (SELECT raw_value, count(*) AS n FROM both_ GROUP BY raw_value), folded AS (SELECT *, {_FOLD} AS f FROM grouped)
        SELECT raw_value, n, CASE WHEN f IS NULL OR f IN ('', 'nan', 'none', 'null') THEN NULL
            WHEN regexp_matches(f, {_pattern(T.POSITIVE_STARTS, T.POSITIVE_WHOLE, T.POSITIVE_INSIDE)}) THEN 1 WHEN regexp_matches(f, {_pattern(inside=T.NEGATIVE_INSIDE)}) THEN 0
            WHEN regexp_full_match(f, '\\++|\\d+\\+') THEN 1 WHEN regexp_matches(f, {_pattern(T.NEGATIVE_STARTS, T.NEGATIVE_WHOLE)}) THEN 0 END AS code FROM folded""",
    "unit_key_normalize": r"""WITH u AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'X10' || (p_size % 100) || '/L' WHEN 1 THEN ' mg/dL ' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN p_type END AS unit FROM part)
        SELECT unit, CASE WHEN coalesce(lower(trim(unit)), '') IN ('', 'nan', 'none', 'null') THEN 'null' WHEN regexp_full_match(lower(trim(unit)), 'x10\d{1,2}/l')
            THEN regexp_replace(lower(trim(unit)), '^x10(\d+)/l$', 'x10^\1/l') ELSE lower(trim(unit)) END AS unit_key, count(*) AS n FROM u GROUP BY ALL""",
    "date_normalize": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
    "json_props_extract": f"WITH {OBS} SELECT k, count(*) AS n, count(DISTINCT doc) AS docs FROM obs GROUP BY k",
    "range_format": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN o_custkey || ' - ' || (o_custkey + 10) WHEN o_orderkey % 4 <> 0 THEN '< ' || (o_custkey + 10)
        WHEN o_orderkey % 3 <> 0 THEN '> ' || o_custkey ELSE '' END AS range_text FROM orders""",
    "bbox_scale": """WITH b AS (SELECT p_partkey, CAST(p_size * 9 AS DOUBLE) AS l, CAST(p_size * 5 AS DOUBLE) AS t, CAST(p_size * 9 + p_partkey % 300 AS DOUBLE) AS r, CAST(p_size * 5 + p_partkey % 40 - 3 AS DOUBLE) AS m FROM part),
        x AS (SELECT *, greatest(l, t, r, m) AS top_ FROM b),
        s AS (SELECT *, round_even(CASE WHEN top_ <= 1 THEN l * 1700 WHEN top_ <= 1000 THEN l * 1700 / 1000 ELSE l END, 0) AS a, round_even(CASE WHEN top_ <= 1 THEN t * 2200 WHEN top_ <= 1000 THEN t * 2200 / 1000 ELSE t END, 0) AS c,
            round_even(CASE WHEN top_ <= 1 THEN r * 1700 WHEN top_ <= 1000 THEN r * 1700 / 1000 ELSE r END, 0) AS d, round_even(CASE WHEN top_ <= 1 THEN m * 2200 WHEN top_ <= 1000 THEN m * 2200 / 1000 ELSE m END, 0) AS e FROM x),
        k AS (SELECT *, greatest(0, least(a, 1699)) AS a2, greatest(0, least(c, 2199)) AS c2, greatest(0, least(d, 1700)) AS d2, greatest(0, least(e, 2200)) AS e2 FROM s)
        SELECT p_partkey, coalesce(r - l <= 40 AND m - t >= 250 AND m - t >= 4 * (r - l), false) AS like_column, CASE WHEN d2 > a2 AND e2 > c2 THEN CAST(a2 AS BIGINT) END AS "left",
            CASE WHEN d2 > a2 AND e2 > c2 THEN CAST(c2 AS BIGINT) END AS top, CASE WHEN d2 > a2 AND e2 > c2 THEN CAST(d2 AS BIGINT) END AS "right",
            CASE WHEN d2 > a2 AND e2 > c2 THEN CAST(e2 AS BIGINT) END AS bottom, CASE WHEN d2 > a2 AND e2 > c2 THEN CAST(greatest(0, a2 - 24) AS BIGINT) END AS padded_left FROM k""",
    "row_identity_token": f"""WITH {OBS} SELECT row_seq, '["d' || doc || '",' || (row_seq % 7) || ',' || row_seq || ']' AS token,
        rtrim(translate(base64(encode('{{"page_number": ' || (row_seq % 7) || ', "result_index": ' || row_seq || ', "source_file": "d' || doc || '"}}')), '+/', '-_'), '=') AS row_id, row_seq AS back FROM obs""",
    "section_keys": r"""WITH x AS (SELECT 'glicose' || lang AS name, CASE WHEN lang = 'en' THEN '' ELSE lower(trim(source)) END AS section, CASE WHEN doc_id % 3 = 0 THEN 'S R C ' || right(source, 1) || ' x' ELSE source END AS spaced FROM documents),
        y AS (SELECT CASE WHEN section = '' THEN 'glicose ' || lang_ ELSE 'glicose ' || lang_ || '|' || section END AS cache_key,
            lower(CASE WHEN regexp_full_match(spaced, '[A-Za-z](\s+[A-Za-z]){2,}') THEN regexp_replace(spaced, '\s+', '', 'g') ELSE spaced END) AS folded FROM (SELECT *, substr(name, 8) AS lang_ FROM x))
        SELECT cache_key, folded, count(*) AS n FROM y GROUP BY ALL""",
    "unit_convert_summary": f"""WITH {PARSED}, rows_ AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Blood - view' WHEN 'N' THEN 'Blood - click' ELSE 'Blood - other' END AS lab,
            CASE l_linestatus WHEN 'O' THEN 'g/L' ELSE 'mg/dL' END AS unit FROM parsed),
        f(lab, unit, factor, prim) AS (VALUES ('Blood - view', 'mg/dL', 1.0, 'mg/dL'), ('Blood - view', 'g/L', 100.0, 'mg/dL'), ('Blood - click', 'g/L', 1.0, 'g/L'), ('Blood - click', 'mg/dL', 0.01, 'g/L'))
        SELECT r.lab AS lab_name, coalesce(prim, r.unit) AS lab_unit, count(*) AS n, count(parsed_value) AS n_values, count(*) FILTER (below) AS n_below,
            sum(CAST(parsed_value * CAST(coalesce(factor, 1) AS DOUBLE) AS DECIMAL(18,4))) AS total, max(2.0::DOUBLE * CAST(coalesce(factor, 1) AS DOUBLE)) AS reference_max
        FROM rows_ r LEFT JOIN f ON r.lab = f.lab AND r.unit = f.unit GROUP BY 1, 2""",
    "name_cache_lookup": f"""WITH cache(key, v) AS (VALUES {_rows(NAME_CACHE)}),
        fold AS (SELECT strip_accents(key) AS f, min(v) AS v FROM cache GROUP BY 1 HAVING count(DISTINCT v) = 1),
        bare AS (SELECT key, v FROM cache c WHERE NOT contains(key, '|') AND NOT EXISTS (SELECT 1 FROM cache o WHERE (o.key LIKE c.key || '|%' OR o.key LIKE '% - ' || c.key) AND o.v <> c.v)),
        ctx AS (SELECT c_mktsegment AS raw_lab_name, {_SECTION} AS raw_section_name, count(*) AS n FROM customer GROUP BY ALL),
        k AS (SELECT *, lower(raw_lab_name) || coalesce('|' || lower(raw_section_name), '') AS e, coalesce(lower(raw_section_name) || ' - ', '') || lower(raw_lab_name) AS g, lower(raw_lab_name) AS b FROM ctx)
        SELECT raw_lab_name, raw_section_name, n, coalesce(c1.v, c2.v, f1.v, f2.v, bare.v, '$UNKNOWN$') AS lab_name_standardized FROM k LEFT JOIN cache c1 ON c1.key = e LEFT JOIN cache c2 ON c2.key = g
            LEFT JOIN fold f1 ON f1.f = strip_accents(e) LEFT JOIN fold f2 ON f2.f = strip_accents(g) LEFT JOIN bare ON bare.key = b""",
    "safe_bare_fallback": """WITH c AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN lower(p_brand) WHEN p_size % 3 = 1 THEN lower(p_brand) || '|' || lower(p_type) ELSE lower(p_type) || ' - ' || lower(p_brand) END AS key,
            CASE WHEN p_size % 3 > 0 THEN lower(p_brand) END AS ctx, CASE WHEN p_size % 3 <> 1 THEN 1 END AS is_bare, 'L' || (p_size % 2) AS v FROM part),
        agree AS (SELECT ctx, min(v) AS lo, max(v) AS hi FROM c WHERE ctx IS NOT NULL GROUP BY ctx)
        SELECT key AS name, v AS value FROM c LEFT JOIN agree a ON c.key = a.ctx WHERE is_bare = 1 AND (lo IS NULL OR (lo = v AND hi = v))""",
    "folded_index": """WITH c AS (SELECT 'e' || lower(source) || '|' || lower(lang) AS folded, CASE WHEN length(source) = 4 THEN lang ELSE source || (doc_id % 2) END AS v FROM documents)
        SELECT folded, min(v) AS value FROM c GROUP BY folded HAVING count(DISTINCT v) = 1""",
    "anti_join_misses": """WITH k AS (SELECT *, lower(trim(p_name)) || '|' || lower(trim(p_brand)) AS key FROM part), cache AS (SELECT DISTINCT key FROM k WHERE p_partkey % 5 <> 0)
        SELECT arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(p_brand, p_partkey) AS p_brand FROM k WHERE key NOT IN (SELECT key FROM cache) GROUP BY key""",
    "percent_sibling_remap": f"""WITH {OBS}, r AS (SELECT CASE WHEN row_seq % 5 = 0 THEN lab_name || ' (%)' ELSE lab_name END AS lab, CASE row_seq % 4 WHEN 0 THEN '%' WHEN 1 THEN 'mg/dL' WHEN 2 THEN 'percent' END AS unit FROM obs)
        SELECT CASE WHEN unit IN ('%', 'percent') AND lab = 'Blood - purchase' THEN 'Blood - purchase (%)' WHEN unit = 'mg/dL' AND lab = 'Blood - purchase (%)' THEN 'Blood - purchase' ELSE lab END AS lab_name, unit, count(*) AS n FROM r GROUP BY ALL""",
    "unit_cache_lookup": f"""WITH {OBS}, r AS (SELECT lab_name AS lab, CASE row_seq % 4 WHEN 0 THEN ' MG/DL' WHEN 1 THEN 'g/l' WHEN 2 THEN '' END AS u FROM obs)
        SELECT lab AS lab_name_standardized, u AS raw_lab_unit, CASE WHEN coalesce(u, '') = '' THEN CASE WHEN lab = 'Blood - purchase' THEN 'mg/dL' WHEN lab = 'Blood - error' THEN 'boolean' ELSE '$UNKNOWN$' END
            WHEN u = ' MG/DL' THEN CASE WHEN lab IN ('Blood - view', 'Blood - click', 'Blood - purchase') THEN 'mg/dL' ELSE '$UNKNOWN$' END
            ELSE CASE WHEN lab IN ('Blood - view', 'Blood - click') THEN 'g/L' ELSE '$UNKNOWN$' END END AS lab_unit_standardized, count(*) AS n FROM r GROUP BY ALL""",
    "variant_range_score": f"""WITH r AS (SELECT o_orderkey, CAST(o_custkey % 60 AS DOUBLE) AS low, CAST(CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 60 + 20 END AS DOUBLE) AS high, CAST(o_custkey % 90 AS DOUBLE) AS v FROM orders),
        c(cand, a, b) AS (VALUES ('absolute', 2.0::DOUBLE, 8.0::DOUBLE), ('share', 40.0, 75.0), ('other', 20.0, 45.0)),
        s AS (SELECT o_orderkey, cand, {_score('low', 'high', 'v', 'a', 'b')} AS score FROM r, c),
        k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY o_orderkey ORDER BY score, cand))
        SELECT o_orderkey, cand AS best_name, round(score, 6) AS best_score FROM k WHERE n = 1 AND (nxt IS NULL OR nxt - score >= 0.25)""",
    "demographic_range": f"""WITH p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex, c_custkey % 90 AS age FROM customer),
        k(lab, pos, key, a, b) AS (VALUES {_rows(AGE_RANGES)}),
        m AS (SELECT c_custkey, lab, pos, a, b, CASE WHEN contains(key, ':') THEN 0 WHEN key = 'default' THEN 2 ELSE 1 END AS rank FROM p, k WHERE key = 'default' OR key = sex
            OR (contains(key, ':') AND split_part(key, ':', 1) = sex AND age BETWEEN CAST(regexp_extract(key, ':(\\d+)', 1) AS INT)
                AND CASE WHEN ends_with(key, '+') THEN 1000 ELSE CAST(regexp_extract(key, '(\\d+)$', 1) AS INT) END)),
        n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, lab ORDER BY rank, pos) AS i FROM m)
        SELECT c_custkey, lab AS lab_name, CAST(a AS DOUBLE) AS range_min, CAST(b AS DOUBLE) AS range_max FROM n WHERE i = 1""",
    "range_flags": f"""WITH {OBS}, {SPEC}, j AS (SELECT o.*, rmin, rmax FROM obs o LEFT JOIN spec s ON o.lab_name = s.lab_name),
        f AS (SELECT lab_name, CASE WHEN value IS NULL THEN NULL WHEN rmin IS NULL AND rmax IS NULL THEN CASE WHEN lab_name = 'Blood - error' THEN value > 0 END ELSE coalesce(value < rmin, false) OR coalesce(value > rmax, false) END AS abnormal,
            CASE WHEN value IS NULL OR (rmin IS NULL AND rmax IS NULL) THEN NULL ELSE coalesce(value < rmin, false) OR coalesce(value > rmax, false) END AS suboptimal FROM j)
        SELECT lab_name, abnormal, suboptimal, count(*) AS n FROM f GROUP BY ALL""",
    "plausibility": f"""WITH {OBS}, {SPEC}, j AS (SELECT o.lab_name, value - 10 AS v, CASE WHEN row_seq % 5 = 0 THEN '%' ELSE lab_unit END AS unit, bmin, bmax FROM obs o LEFT JOIN spec s ON o.lab_name = s.lab_name)
        SELECT lab_name, CASE WHEN v < 0 THEN 'NEGATIVE_VALUE' WHEN unit = '%' AND v > 100 THEN 'PERCENTAGE_BOUNDS' WHEN coalesce(v < bmin, false) OR coalesce(v > bmax, false) THEN 'IMPOSSIBLE_VALUE' END AS code, count(*) AS n FROM j GROUP BY ALL""",
    "temporal_anomaly": f"WITH {OBS}, {SPEC}, {_TEMPORAL} SELECT row_seq, doc, lab_name FROM jumps",
    "component_total": """WITH l AS (SELECT l_orderkey AS d, 'c' || (l_linenumber % 3) AS lab, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS n FROM lineitem),
        x AS (SELECT * FROM l WHERE n = 1) SELECT a.lab AS lab_name, count(*) AS n, sum(CAST(a.v AS DECIMAL(18,2))) AS total FROM x a JOIN x t ON a.d = t.d AND t.lab = 'c0' AND a.lab <> 'c0' WHERE a.v > t.v * CAST(1.05 AS DOUBLE) GROUP BY 1""",
    "relationship_check": f"""WITH {OBS}, {_DAYS}, p AS (SELECT doc, date, max(v) FILTER (lab_name = 'Blood - view') AS vi, max(v) FILTER (lab_name = 'Blood - click') AS c, max(v) FILTER (lab_name = 'Blood - error') AS e,
            max(v) FILTER (lab_name = 'Blood - signup') AS s FROM lastv GROUP BY doc, date),
        d AS (SELECT 'sum' AS name, {_DIFF.format(a='vi', e='(c + e * 2)')} AS diff, 30 AS tol FROM p UNION ALL SELECT 'mean', {_DIFF.format(a='s', e='((vi + c) / 2)')}, 50 FROM p)
        SELECT name, count(*) AS n, round(sum(CAST(diff AS DECIMAL(28,6))), 2) AS difference FROM d WHERE diff > tol GROUP BY name""",
    "format_artifacts": f"""WITH {PARSED}, x AS (SELECT l_returnflag, CASE WHEN l_linenumber % 4 = 0 THEN raw_value || '.123456' ELSE raw_value END AS r, parsed_value, l_linenumber % 4 = 0 AS long_ FROM parsed)
        SELECT l_returnflag, count(*) AS n FROM x WHERE long_ OR (parsed_value IS NOT NULL AND regexp_matches(replace(r, ',', '.'), '^[\\d.\\-+<>≤≥]+\\s*=\\s*\\d+')) GROUP BY 1""",
    "reference_range_check": """WITH r AS (SELECT o_orderkey % 500 AS v, o_custkey % 17 AS lo, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 23 END AS hi FROM orders)
        SELECT CASE WHEN lo > hi THEN 'RANGE_INCONSISTENCY' WHEN hi - lo > 0 AND CASE WHEN v < lo THEN lo - v WHEN v > hi THEN v - hi ELSE 0 END > 10 * (hi - lo) THEN 'EXTREME_DEVIATION' END AS code, count(*) AS n FROM r GROUP BY 1""",
    "duplicate_flags": f"WITH {_GROUPS} SELECT row_seq, doc, date, lab_name FROM grouped WHERE date IS NOT NULL AND {_DUPLICATE}",
    "validation_reasons": f"""WITH {_GROUPS}, {SPEC}, {_TEMPORAL}, {_DAYS},
        p AS (SELECT doc, date, max(v) FILTER (lab_name = 'Blood - view') AS vi, max(v) FILTER (lab_name = 'Blood - click') AS c, max(v) FILTER (lab_name = 'Blood - error') AS e FROM lastv GROUP BY doc, date),
        off AS (SELECT doc, date FROM p WHERE {_DIFF.format(a='vi', e='(c + e * 2)')} > 30),
        f AS (SELECT g.*, bmin, bmax FROM grouped g LEFT JOIN spec s ON g.lab_name = s.lab_name)
        SELECT 'NEGATIVE_VALUE' AS reason, count(*) AS n FROM f WHERE value < 0 HAVING count(*) > 0
        UNION ALL SELECT 'IMPOSSIBLE_VALUE', count(*) FROM f WHERE value >= 0 AND (coalesce(value < bmin, false) OR coalesce(value > bmax, false)) HAVING count(*) > 0
        UNION ALL SELECT 'RELATIONSHIP_MISMATCH', count(*) FROM f JOIN off ON f.doc = off.doc AND f.date = off.date AND f.lab_name = 'Blood - view' HAVING count(*) > 0
        UNION ALL SELECT 'TEMPORAL_ANOMALY', count(*) FROM jumps HAVING count(*) > 0
        UNION ALL SELECT 'EXTREME_DEVIATION', count(*) FROM f WHERE CASE WHEN value < 10 THEN 10 - value WHEN value > 11 THEN value - 11 ELSE 0 END > 10 HAVING count(*) > 0
        UNION ALL SELECT 'DUPLICATE_ENTRY', count(*) FROM f WHERE {_DUPLICATE} HAVING count(*) > 0""",
    "suspicious_ranges": f"""WITH {OBS}, {SPEC}, r AS (SELECT o.lab_name, value, value AS lo, CASE WHEN row_seq % 3 = 0 THEN value - 1 ELSE value * 9 END AS hi, CASE WHEN row_seq % 5 = 0 THEN '%' END AS unit,
            s.rmin, s.rmax, t.rmin AS smin, t.rmax AS smax FROM obs o LEFT JOIN spec s ON o.lab_name = s.lab_name LEFT JOIN spec t ON o.lab_name || ' (%)' = t.lab_name),
        q AS (SELECT *, CASE WHEN rmin > 0 THEN lo / rmin END AS q1, CASE WHEN rmax > 0 THEN hi / rmax END AS q2, ({_score('lo', 'hi', 'value', 'rmin', 'rmax')}) - ({_score('lo', 'hi', 'value', 'smin', 'smax')}) AS better FROM r)
        SELECT lab_name, coalesce(lo > hi, false) OR coalesce(unit = '%' AND hi > 100, false) OR ((q1 IS NOT NULL OR q2 IS NOT NULL) AND coalesce(q1 > 10 OR q1 < 0.1, true) AND coalesce(q2 > 10 OR q2 < 0.1, true)
            AND NOT coalesce(better >= 0.25, false)) AS suspicious_range, count(*) AS n FROM q GROUP BY ALL""",
    "unknown_mappings": f"""WITH {OBS}, r AS (SELECT coalesce(CASE row_seq % 7 WHEN 0 THEN '$UNKNOWN$' WHEN 1 THEN NULL ELSE lab_name END, '') AS lab, coalesce(CASE row_seq % 5 WHEN 0 THEN '$UNKNOWN$' ELSE lab_unit END, '') AS unit FROM obs)
        SELECT lab = '$UNKNOWN$' AS unknown_lab, lab <> '$UNKNOWN$' AND unit IN ('', '$UNKNOWN$') AS unknown_unit, count(*) AS n FROM r GROUP BY ALL""",
    "dedup_prefer_primary": f"""WITH {OBS}, {SPEC}, n AS (SELECT o.*, row_number() OVER (PARTITION BY doc, date, o.lab_name ORDER BY CASE WHEN lab_unit = primary_unit THEN 0 ELSE 1 END, row_seq) AS i FROM obs o LEFT JOIN spec s ON o.lab_name = s.lab_name)
        SELECT row_seq, doc, date, lab_name, lab_unit FROM n WHERE i = 1""",
    "latest_only": f"WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY lab_name ORDER BY date DESC NULLS LAST, row_seq) AS i FROM obs) SELECT lab_name, date, row_seq, value FROM n WHERE i = 1",
    "content_hash_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS original, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_copy, substr(sha256(text), 1, 8) AS hash8 FROM documents",
    "full_row_duplicates": "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY coalesce(text, 'nan'), coalesce(lang, 'nan'), coalesce(CAST(n_chars AS VARCHAR), 'nan')) AS n FROM documents) WHERE n > 1",
    "unique_key_violations": f"WITH {OBS} SELECT row_seq, doc, date, lab_name FROM (SELECT *, count(*) OVER (PARTITION BY doc, date, lab_name) AS n FROM obs) WHERE n > 1",
    "outliers_3sigma": f"""WITH {OBS}, g AS (SELECT lab_name, lab_unit, count(*) AS c, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM obs WHERE lab_unit IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY lab_name ORDER BY c DESC, lab_unit) AS i FROM g)
        SELECT o.row_seq, o.lab_name, o.value FROM obs o JOIN t ON o.lab_name = t.lab_name AND o.lab_unit = t.lab_unit WHERE i = 1 AND n >= 5 AND sd <> 0 AND abs(value - m) > 3 * sd""",
    "unit_inconsistency": f"WITH {OBS} SELECT lab_name, count(DISTINCT lab_unit) AS n_units FROM obs GROUP BY lab_name HAVING count(DISTINCT lab_unit) > 1",
    "integrity_violations": f"""WITH {OBS}, r AS (SELECT row_seq, CASE WHEN row_seq % 50 <> 0 THEN date END AS date, lab_name, CASE row_seq % 4 WHEN 0 THEN '%' WHEN 1 THEN 'boolean' ELSE 'mg/dL' END AS unit, value FROM obs),
        g AS (SELECT lab_name, unit, count(*) AS c, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM r GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY lab_name ORDER BY c DESC, unit) AS i FROM g),
        x AS (SELECT 'no date' AS chk FROM r WHERE date IS NULL
            UNION ALL SELECT 'repeated row' FROM (SELECT count(*) OVER (PARTITION BY date, lab_name, unit, value) AS n FROM r) WHERE n > 1
            UNION ALL SELECT 'repeated date and lab' FROM (SELECT count(*) OVER (PARTITION BY date, lab_name) AS n FROM r) WHERE n > 1
            UNION ALL SELECT 'percent without (%)' FROM r WHERE unit = '%' AND NOT ends_with(lab_name, '(%)')
            UNION ALL SELECT 'percent out of bounds' FROM r WHERE unit = '%' AND (value < 0 OR value > 100)
            UNION ALL SELECT 'boolean not 0 or 1' FROM r WHERE unit = 'boolean' AND (value IS NULL OR value NOT IN (0, 1))
            UNION ALL SELECT 'inconsistent unit' FROM r WHERE lab_name IN (SELECT lab_name FROM r GROUP BY 1 HAVING count(DISTINCT unit) > 1)
            UNION ALL SELECT 'outlier' FROM r JOIN t ON r.lab_name = t.lab_name AND r.unit = t.unit WHERE i = 1 AND n >= 5 AND sd <> 0 AND abs(value - m) > 3 * sd)
        SELECT chk AS "check", count(*) AS n FROM x GROUP BY chk""",
    "spec_schema_violations": """SELECT * FROM (VALUES ('name and lab_type differ', 'Urine - odd'), ('percent unit without (%) in the name', 'Urine - odd'), ('loinc_code has no digit', 'Urine - odd'), ('loinc_code repeats', 'Blood - error'),
        ('loinc_code repeats', 'Blood - purchase'), ('biological limits are not in order', 'Urine - odd'), ('max_daily_change is not positive', 'Urine - odd'), ('alternative without a unit', 'Urine - odd'), ('factor is not positive', 'Urine - odd'),
        ('range without bounds', 'Urine - odd'), ('range is not in order', 'Urine - odd'), ('relationship without name, target or formula', ''), ('tolerance is not within 0 to 100', '')) AS v(rule, lab_name)""",
    "review_summary": f"""WITH {DECIDED}, s AS (SELECT source, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status IS NULL) AS pending,
            count(*) FILTER (doc_id % 97 = 0) AS markers FROM decided GROUP BY source)
        SELECT *, accepted + rejected AS reviewed, pending = 0 AND markers = 0 AS fixture_ready FROM s""",
    "document_summary": f"""WITH {DECIDED} SELECT source, count(*) AS results, count(*) FILTER (n_chars > 1000) AS boxes, count(*) FILTER (lang <> 'en') AS needs_review, count(*) FILTER (status IS NULL) AS unreviewed
        FROM decided WHERE source IS NOT NULL GROUP BY source""",
    "reason_codes_explode": f"WITH {REASONS}, x AS (SELECT trim(unnest(string_split(review_reason, ';'))) AS reason FROM reasons) SELECT reason, count(*) AS n FROM x WHERE reason <> '' GROUP BY reason",
    "corpus_report": f"""WITH {REASONS}, x AS (SELECT lab_name, doc, trim(unnest(string_split(review_reason || CASE WHEN value < 5 THEN 'NEGATIVE_VALUE; ' ELSE '' END, ';'))) AS reason FROM reasons)
        SELECT lab_name, reason, count(*) AS n, count(DISTINCT doc) AS docs FROM x WHERE reason <> '' GROUP BY ALL""",
    "summary_cards": f"""WITH {FLAGGED} SELECT count(*) AS n_rows, count(DISTINCT lab_name) AS n_labs, min(year(date)) AS first_year, max(year(date)) AS last_year, count(*) FILTER (is_out_of_reference) AS n_abnormal,
        count(*) FILTER (is_out_of_optimal_range) AS n_suboptimal, count(*) FILTER (review_status <> '') AS n_reviewed, count(*) FILTER (review_status = 'accepted') AS n_accepted,
        count(*) FILTER (review_status = 'rejected') AS n_rejected, count(*) FILTER (review_needed) AS n_needs_review FROM flagged""",
    "explorer_filter_sort": f"WITH {FLAGGED} SELECT row_seq, lab_name, date, value FROM flagged WHERE lab_name IN ('Blood - view', 'Blood - click') AND review_needed AND coalesce(review_status, '') = '' ORDER BY value DESC",
    "latest_by_pill": f"""WITH {FLAGGED}, l AS (SELECT *, row_number() OVER (PARTITION BY lab_name ORDER BY date DESC NULLS LAST, row_seq) AS i FROM flagged), t AS (SELECT *, false AS latest FROM l UNION ALL SELECT *, true FROM l WHERE i = 1),
        p AS (SELECT 'All' AS pill, latest, true AS hit FROM t UNION ALL SELECT 'Unreviewed', latest, coalesce(review_status, '') = '' FROM t UNION ALL SELECT 'Abnormal', latest, is_out_of_reference FROM t
            UNION ALL SELECT 'Suboptimal', latest, is_out_of_optimal_range FROM t UNION ALL SELECT 'Accepted', latest, review_status = 'accepted' FROM t UNION ALL SELECT 'Rejected', latest, review_status = 'rejected' FROM t)
        SELECT pill, latest, count(*) FILTER (hit) AS n FROM p GROUP BY ALL""",
    "next_pending": f"""WITH {FLAGGED}, c AS (SELECT source_file, arg_min(page_number, row_seq) AS p, arg_min(result_index, row_seq) AS x FROM flagged GROUP BY 1),
        w AS (SELECT f.*, row_number() OVER (PARTITION BY f.source_file ORDER BY CASE WHEN page_number = p AND result_index > x THEN 0 WHEN page_number > p THEN 1 ELSE 2 END, page_number, result_index) AS i
            FROM flagged f JOIN c ON f.source_file = c.source_file WHERE coalesce(review_status, '') = '')
        SELECT source_file, page_number, result_index FROM w WHERE i = 1""",
    "review_queue": f"""WITH {FLAGGED} SELECT source_file, page_number, result_index, row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN coalesce(review_status, '') = '' THEN 0 ELSE 1 END, page_number, result_index) - 1 AS position FROM flagged""",
    "latest_decisions": """WITH d AS (SELECT 'u' || user_id AS source_file, user_id % 3 AS page_number, event_id % 5 AS result_index, arg_max(event_type, event_id) AS t, max(event_id) AS e FROM events GROUP BY 1, 2, 3)
        SELECT source_file, page_number, result_index, CASE t WHEN 'view' THEN 'accepted' WHEN 'error' THEN 'rejected' END AS review_status, lpad(CAST(e AS VARCHAR), 12, '0') AS review_completed_at FROM d""",
    "export_projection": f"""WITH {FLAGGED}, x AS (SELECT date, CASE row_seq % 6 WHEN 0 THEN '$UNKNOWN$' WHEN 1 THEN NULL ELSE lab_name END AS lab_name, value, lab_unit, source_file, page_number, result_index, review_needed, review_reason, 'r' || k AS raw_value, CAST(NULL AS VARCHAR) AS lab_type FROM flagged)
        SELECT * FROM x WHERE coalesce(lab_name, '') <> '$UNKNOWN$' AND coalesce(lab_unit, '') <> ''""",
    "publish_accepted": f"""WITH {FLAGGED}, n AS (SELECT *, row_number() OVER (PARTITION BY date, lab_name ORDER BY CASE WHEN lab_unit = 'g/L' THEN 0 ELSE 1 END, row_seq) AS i FROM flagged WHERE review_status = 'accepted' AND lab_unit IS NOT NULL)
        SELECT date, lab_name, value, lab_unit, result_index, replace(review_reason, 'DUPLICATE_ENTRY; ', '') <> '' AS review_needed, replace(review_reason, 'DUPLICATE_ENTRY; ', '') AS review_reason FROM n WHERE i = 1""",
    "mode_reference": """WITH c AS (SELECT o_orderpriority, o_custkey % 20 AS low, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, low) AS i FROM c)
        SELECT o_orderpriority, low AS mode_low FROM r WHERE i = 1""",
    "plot_series": f"WITH {OBS} SELECT row_seq, date, value FROM obs WHERE lab_name = 'Blood - view' AND date IS NOT NULL AND value IS NOT NULL",
    "section_backfill": f"""WITH {TURNS}, m(w, s) AS (VALUES {_rows(standardize.URINE_SECTIONS.items())}), j AS (SELECT t.*, s, count(s) OVER (PARTITION BY source_file) AS n FROM turns t LEFT JOIN m ON strip_accents(lower(raw_lab_name)) = w)
        SELECT source_file, result_index, raw_lab_name, CASE WHEN n >= 3 AND coalesce(raw_section_name, '') = '' THEN coalesce(s, raw_section_name) ELSE raw_section_name END AS raw_section_name FROM j""",
    "companion_variants": f"""WITH {TURNS}, b AS (SELECT *, max(role = 'user') OVER (PARTITION BY source_file) AND max(role <> 'user') OVER (PARTITION BY source_file) AS both_ FROM turns)
        SELECT source_file, result_index, 'Glicose' || CASE WHEN NOT both_ THEN '' WHEN role = 'user' THEN ' (qualitative)' ELSE ' (quantitative)' END AS lookup_name FROM b""",
    "union_by_name": """SELECT nation, segment, count(*) AS n FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY ALL""",
    "stale_difference": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "categorize_rules": r"""SELECT CASE WHEN contains(lower(text), 'license') THEN 'licence' WHEN regexp_matches(lower(text), '@[a-z0-9]+\.') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'loud' ELSE 'prose' END AS category,
        lang, count(*) AS n FROM documents GROUP BY ALL""",
}
