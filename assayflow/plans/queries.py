"""Registered queries: each runs operators of the engine over whole driver tables. ``oracles`` has the same results as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayflow.functions import dates, numeric, text as T
from assayflow.operators import dedup, explore, integrity, normalize, review, standardize, validate
from assayflow.operators.specs import Specs, demographic_ranges, spec_violations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- inputs shared by queries ---------------------------------------------------------------------
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of a lab."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("Blood - "), "event_type").alias("lab_name"), F.col("ts").cast("date").alias("date"), "value", F.col("user_id").alias("doc"), F.col("event_id").alias("row_seq"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'g/L' END").alias("lab_unit"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as raw values of ten kinds."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))
    return lines.withColumn("raw_value", F.expr("""CASE l_orderkey % 10 WHEN 0 THEN '<' || q WHEN 1 THEN q || ',5' WHEN 2 THEN q || ' a ' || (q + 2) || '/campo'
        WHEN 3 THEN q || '.6=1946' WHEN 4 THEN 'NEGATIVO' WHEN 5 THEN 'Não detetado' WHEN 6 THEN 'Ca. ' || q WHEN 7 THEN q || ' .0' WHEN 8 THEN q || ' 000' WHEN 9 THEN '1+' END""")).drop("q")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


LABS = {
    "Blood - view": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="1-1", biological_min=0, biological_max=90, max_daily_change=20, alternatives=[{"unit": "g/L", "factor": 100.0}], ranges={"default": [10, 60]}),
    "Blood - click": dict(lab_type="blood", primary_unit="g/L", loinc_code="2-2", biological_min=5, biological_max=80, max_daily_change=10, alternatives=[{"unit": "mg/dL", "factor": 0.01}], ranges={"default": [20, None]}),
    "Blood - error": dict(lab_type="blood", primary_unit="boolean", loinc_code="3-3", max_daily_change=5),
    "Blood - purchase": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="3-3", biological_max=50, max_daily_change=40, ranges={"default": [None, 40]}),
    "Blood - purchase (%)": dict(lab_type="blood", primary_unit="%", loinc_code="5-5", ranges={"default": [5, 95]}),
    "Urine - odd": dict(lab_type="blood", primary_unit="%", loinc_code="x", biological_min=9, biological_max=3, max_daily_change=-1, alternatives=[{"unit": "", "factor": 0}], ranges={"default": [None, None], "male": [5, 1]}),
    "_relationships": [{"name": "sum", "target": "Blood - view", "formula": "Blood - click + Blood - error * 2", "tolerance_percent": 30}, {"name": "", "target": "t", "formula": "f", "tolerance_percent": 150}],
}


def specs(spark: SparkSession) -> Specs:
    return Specs.from_dict(spark, LABS)


# ---- scalar functions -------------------------------------------------------------------------------
@query
def number_parse(spark, sf_dir):
    p = numeric.with_parsed(raw_text(spark, sf_dir), "raw_value", "value", "is_below", "is_above")
    return p.select("l_orderkey", "l_linenumber", "raw_value", "value", "is_below", "is_above")


@query
def comparison_flags(spark, sf_dir):
    c = raw_text(spark, sf_dir).select(numeric.comparison(F.col("raw_value")).alias("c"))
    return c.groupBy(F.col("c.below").alias("is_below"), F.col("c.above").alias("is_above")).agg(F.count(F.lit(1)).alias("n"))


@query
def interval_midpoint(spark, sf_dir):
    return raw_text(spark, sf_dir).withColumn("midpoint", numeric.interval_midpoint(F.col("raw_value"))).filter("midpoint is not null").select("l_orderkey", "l_linenumber", "midpoint")


WORDS = (
    "Límpido", "Não detetado", "Cultura estéril após incubação", "Amarela ouro", "(*)", "1+", "+++", "Raras células", "DUVIDOSO", "traço", "não reactivo", "non-reactive",
    "gram negativo", "Negativo", " POSITIVO ", "nan", "", "Turvo", "Levemente turvo", "Ausência", "citrina", "vestígios", "hiperplasiado", "NR", "R", "Normal", "2+ ", "sem alterações",
)


@query
def qualitative_classify(spark, sf_dir):
    words = values(spark, "raw_value string", [(w,) for w in WORDS])
    rows = raw_text(spark, sf_dir).select("raw_value").union(words).union(read(spark, sf_dir, "documents").select("source"))
    return rows.groupBy("raw_value").agg(F.count(F.lit(1)).alias("n")).withColumn("code", T.classify_qualitative(F.col("raw_value")))


@query
def unit_key_normalize(spark, sf_dir):
    unit = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'X10' || (p_size % 100) || '/L' WHEN 1 THEN ' mg/dL ' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN p_type END")
    rows = read(spark, sf_dir, "part").select(unit.alias("unit"))
    return rows.groupBy("unit", T.unit_key(F.col("unit")).alias("unit_key")).agg(F.count(F.lit(1)).alias("n"))


@query
def date_normalize(spark, sf_dir):
    text = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'dd-MM-yyyy')
        WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 3 THEN '0000-00-00' ELSE o_orderpriority END""")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(text).alias("iso"))


@query
def json_props_extract(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


@query
def range_format(spark, sf_dir):
    low, high = F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END"), F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 10 END")
    return read(spark, sf_dir, "orders").select("o_orderkey", numeric.range_text(low, high).alias("range_text"))


@query
def bbox_scale(spark, sf_dir):
    box = [F.expr(e).cast("double") for e in ("p_size * 9", "p_size * 5", "p_size * 9 + p_partkey % 300", "p_size * 5 + p_partkey % 40 - 3")]
    rows = read(spark, sf_dir, "part").select("p_partkey", numeric.scale_box(box, F.lit(1700), F.lit(2200)).alias("b"), numeric.column_like_box(*box).alias("like_column"))
    padded = numeric.pad_box(F.col("b"), F.lit(1700), F.lit(2200))
    return rows.select("p_partkey", "like_column", *(F.col("b")[c].alias(c) for c in ("left", "top", "right", "bottom")), F.when(F.col("b").isNotNull(), padded["left"]).alias("padded_left"))


@query
def row_identity_token(spark, sf_dir):
    doc, page, index = F.concat(F.lit("d"), F.col("doc").cast("string")), F.col("row_seq") % 7, F.col("row_seq")
    rows = obs(spark, sf_dir).select("row_seq", T.row_token(doc, page, index).alias("token"), T.row_id(doc, page, index).alias("row_id"))
    return rows.withColumn("back", T.decode_row_id(F.col("row_id"))["result_index"])


@query
def section_keys(spark, sf_dir):
    spaced = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'S R C ' || right(source, 1) || ' x' ELSE source END")
    rows = read(spark, sf_dir, "documents").select(T.cache_key(F.concat(F.lit(" Glicose "), "lang"), F.when(F.col("lang") == "en", "nan").otherwise(F.col("source"))).alias("cache_key"), T.folded_key(spaced).alias("folded"))
    return rows.groupBy("cache_key", "folded").agg(F.count(F.lit(1)).alias("n"))


# ---- lookups ----------------------------------------------------------------------------------------
@query
def unit_convert_summary(spark, sf_dir):
    """The flagship: raw text to values, in primary units, summed up."""
    labs = F.expr("CASE l_returnflag WHEN 'A' THEN 'Blood - view' WHEN 'N' THEN 'Blood - click' ELSE 'Blood - other' END")
    units = F.expr("CASE l_linestatus WHEN 'O' THEN 'g/L' ELSE 'mg/dL' END")
    rows = raw_text(spark, sf_dir).select("raw_value", labs.alias("lab_name_standardized"), units.alias("lab_unit_standardized"), F.lit(None).cast("double").alias("raw_reference_min"), F.lit(2.0).alias("raw_reference_max"))
    rows = normalize.convert_units(normalize.preprocess_values(rows), specs(spark))
    return rows.groupBy(F.col("lab_name_standardized").alias("lab_name"), F.col("lab_unit_primary").alias("lab_unit")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value_primary").alias("n_values"), review.count_if(F.col("is_below_limit")).alias("n_below"),
        F.sum(F.col("value_primary").cast("decimal(18,4)")).alias("total"), F.max("reference_max_primary").alias("reference_max"),
    )


NAME_CACHE = [
    ("automobile", "Blood - Automobile"), ("building|section 1", "Blood - Building 1"), ("building", "Blood - Building"), ("section 2 - furniture", "Blood - Furniture 2"),
    ("machinery", "Blood - Machinery"), ("machinery|section 3", "Blood - Machinery"), ("maquinaria", "Blood - Machinery"), ("household|secção 0", "Blood - Household 0"), ("household|secçao 0", "Blood - Household 0"),
]


@query
def name_cache_lookup(spark, sf_dir):
    section = F.expr("CASE WHEN c_nationkey % 4 = 0 THEN 'Seccao 0' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Section ' || (c_nationkey % 4) END")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("raw_lab_name"), section.alias("raw_section_name"))
    found = standardize.standardize_names(rows, values(spark, "key string, lab_name string", NAME_CACHE))
    return found.groupBy("raw_lab_name", "raw_section_name", "lab_name_standardized").agg(F.count(F.lit(1)).alias("n"))


def _brand_cache(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr("CASE WHEN p_size % 3 = 0 THEN lower(p_brand) WHEN p_size % 3 = 1 THEN lower(p_brand) || '|' || lower(p_type) ELSE lower(p_type) || ' - ' || lower(p_brand) END AS key", "'L' || (p_size % 2) AS lab_name").distinct()


@query
def safe_bare_fallback(spark, sf_dir):
    return standardize.safe_bare_names(_brand_cache(spark, sf_dir)).select("name", "value")


@query
def folded_index(spark, sf_dir):
    cache = read(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'É' ELSE 'e' END || source || '|' || lang AS key", "CASE WHEN length(source) = 4 THEN lang ELSE source || (doc_id % 2) END AS lab_name")
    return standardize.folded_index(cache)


@query
def anti_join_misses(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    cache = rows.filter("p_partkey % 5 <> 0").select(T.cache_key(F.col("p_name"), F.col("p_brand")).alias("key")).distinct()
    return standardize.uncached(rows, cache, T.cache_key(F.col("p_name"), F.col("p_brand")), "p_partkey", ["p_partkey", "p_name", "p_brand"])


@query
def percent_sibling_remap(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("unit", F.expr("CASE row_seq % 4 WHEN 0 THEN '%' WHEN 1 THEN 'mg/dL' WHEN 2 THEN 'percent' END"))
    rows = rows.withColumn("lab_name", F.expr("CASE WHEN row_seq % 5 = 0 THEN lab_name || ' (%)' ELSE lab_name END"))
    return standardize.remap_percent_siblings(rows, specs(spark)).groupBy("lab_name", "unit").agg(F.count(F.lit(1)).alias("n"))


@query
def unit_cache_lookup(spark, sf_dir):
    rows = obs(spark, sf_dir).select(F.col("lab_name").alias("lab_name_standardized"), F.expr("CASE row_seq % 4 WHEN 0 THEN ' MG/DL' WHEN 1 THEN 'g/l' WHEN 2 THEN '' END").alias("raw_lab_unit"))
    cache = values(spark, "key string, unit string", [("mg/dl|blood - view", "mg/dL"), ("g/l|blood - click", "mg/dL"), ("null|blood - purchase", "mg/dL")])
    rows = standardize.implied_units(standardize.explicit_units(standardize.standardize_units(rows, cache), specs(spark)), specs(spark))
    return rows.groupBy("lab_name_standardized", "raw_lab_unit", "lab_unit_standardized").agg(F.count(F.lit(1)).alias("n"))


CANDIDATES = (("absolute", 2.0, 8.0), ("share", 40.0, 75.0), ("other", 20.0, 45.0))


@query
def variant_range_score(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 60 AS DOUBLE) AS low", "CAST(CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 60 + 20 END AS DOUBLE) AS high", "CAST(o_custkey % 90 AS DOUBLE) AS v")
    cands = rows.select("o_orderkey", F.inline(F.array(*(F.struct(F.lit(n).alias("cand"), F.lit(a).alias("cand_min"), F.lit(b).alias("cand_max")) for n, a, b in CANDIDATES))))
    return standardize.best_candidate(rows, cands, ["o_orderkey"], "low", "high", "v").select("o_orderkey", "best_name", F.round("best_score", 6).alias("best_score"))


AGE_RANGES = [("Blood - view", 0, "male:18-40", 1.0, 2.0), ("Blood - view", 1, "male:65+", 3.0, 4.0), ("Blood - view", 2, "male", 5.0, 6.0), ("Blood - view", 3, "default", 7.0, 8.0), ("Blood - click", 0, "female:30-50", 9.0, None), ("Blood - click", 1, "female", None, 11.0)]


@query
def demographic_range(spark, sf_dir):
    people = read(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex", "CAST(c_custkey % 90 AS INT) AS age")
    return demographic_ranges(people, values(spark, "lab_name string, pos int, key string, min double, max double", AGE_RANGES)).select("c_custkey", "lab_name", "range_min", "range_max")


# ---- checks -----------------------------------------------------------------------------------------
def _specs_view(spark, sf_dir):
    return obs(spark, sf_dir).join(specs(spark).default_ranges(), "lab_name", "left")


@query
def range_flags(spark, sf_dir):
    rows = _specs_view(spark, sf_dir)
    flag = numeric.abnormal(F.col("value"), F.col("range_min"), F.col("range_max"), F.col("lab_name") == "Blood - error")
    return rows.groupBy("lab_name", flag.alias("abnormal"), numeric.suboptimal(F.col("value"), F.col("range_min"), F.col("range_max")).alias("suboptimal")).agg(F.count(F.lit(1)).alias("n"))


@query
def plausibility(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumns({"value": F.col("value") - 10, "lab_unit": F.expr("CASE WHEN row_seq % 5 = 0 THEN '%' ELSE lab_unit END")})
    return validate.plausibility(rows, specs(spark)).groupBy("lab_name", F.col("plausibility_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query
def temporal_anomaly(spark, sf_dir):
    rows = validate.temporal_anomaly(obs(spark, sf_dir), specs(spark).spec, ["doc"], ["row_seq"])
    return rows.filter("temporal_anomaly").select("row_seq", "doc", "lab_name")


@query
def component_total(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS date", "'c' || (l_linenumber % 3) AS lab_name", "l_quantity AS value", "l_linenumber AS row_seq", "l_partkey AS part")
    over = validate.components_over_total(rows, [], ["row_seq", "part", "value"], (("c1", "c0"), ("c2", "c0")))
    return over.groupBy("lab_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


@query
def relationship_check(spark, sf_dir):
    ties = [("sum", "Blood - view", "Blood - click + Blood - error * 2", 30.0), ("mean", "Blood - signup", "(Blood - view + Blood - click) / 2", 50.0)]
    rows = validate.relationship_mismatches(obs(spark, sf_dir), ties, ["doc"], ["row_seq"])
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("difference").cast("decimal(28,6)")), 2).alias("difference"))


@query
def format_artifacts(spark, sf_dir):
    rows = raw_text(spark, sf_dir).withColumn("raw_value", F.expr("CASE WHEN l_linenumber % 4 = 0 THEN raw_value || '.123456' ELSE raw_value END"))
    flag = validate.format_artifact(F.col("raw_value"), numeric.parse_value(F.col("raw_value"))["value"])
    return rows.filter(flag).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query
def reference_range_check(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 500 AS DOUBLE) AS v", "CAST(o_custkey % 17 AS DOUBLE) AS low", "CAST(CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 23 END AS DOUBLE) AS high")
    return rows.groupBy(validate.range_code(F.col("v"), F.col("low"), F.col("high")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _limits(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_below_limit": F.col("k") % 10 == 0, "is_above_limit": F.lit(False), "raw_value": F.concat(F.lit("v"), F.floor(F.col("value") / 10).cast("string"))})


@query
def duplicate_flags(spark, sf_dir):
    rows = validate.duplicate_entries(_limits(obs(spark, sf_dir)), ["doc"])
    return rows.filter("duplicate_entry").select("row_seq", "doc", "date", "lab_name")


@query
def validation_reasons(spark, sf_dir):
    """All checks at once: how often each reason is given."""
    rows = _limits(obs(spark, sf_dir)).withColumns({"reference_min": F.lit(10.0), "reference_max": F.lit(11.0), "source_file": F.col("doc"), "page_number": F.lit(1), "result_index": F.col("row_seq")})
    s = specs(spark)
    return review.reason_counts(validate.validate(rows, Specs(s.spec, s.unit_factor, s.spec_range, s.relationship.filter("name = 'sum'")), ["doc"], ["row_seq"]))


@query
def suspicious_ranges(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumns({"reference_min": F.col("value"), "reference_max": F.when(F.col("row_seq") % 3 == 0, F.col("value") - 1).otherwise(F.col("value") * 9), "lab_unit": F.expr("CASE WHEN row_seq % 5 = 0 THEN '%' END")})
    return validate.suspicious_range(rows, specs(spark)).groupBy("lab_name", "suspicious_range").agg(F.count(F.lit(1)).alias("n"))


@query
def unknown_mappings(spark, sf_dir):
    rows = obs(spark, sf_dir).select(F.expr("CASE row_seq % 7 WHEN 0 THEN '$UNKNOWN$' WHEN 1 THEN NULL ELSE lab_name END").alias("lab_name_standardized"), F.expr("CASE row_seq % 5 WHEN 0 THEN '$UNKNOWN$' ELSE lab_unit END").alias("lab_unit_standardized"))
    return validate.unknown_mappings(rows).groupBy("unknown_lab", "unknown_unit").agg(F.count(F.lit(1)).alias("n"))


# ---- which row stays ----------------------------------------------------------------------------------
@query
def dedup_prefer_primary(spark, sf_dir):
    rows = obs(spark, sf_dir).join(specs(spark).spec.select("lab_name", "primary_unit"), "lab_name", "left")
    return dedup.first_of(rows, ["doc", "date", "lab_name"], [F.when(F.col("lab_unit") == F.col("primary_unit"), 0).otherwise(1), "row_seq"]).select("row_seq", "doc", "date", "lab_name", "lab_unit")


@query
def latest_only(spark, sf_dir):
    return dedup.latest_only(obs(spark, sf_dir), ["row_seq"]).select("lab_name", "date", "row_seq", "value")


@query
def content_hash_dedup(spark, sf_dir):
    rows = dedup.content_copies(read(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.select("doc_id", "original", "is_copy", F.substring("content_hash", 1, 8).alias("hash8"))


@query
def full_row_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return dedup.repeated_rows(rows, ["text", "lang", "n_chars"]).select("doc_id")


@query
def unique_key_violations(spark, sf_dir):
    return dedup.repeated_keys(obs(spark, sf_dir), ["doc", "date", "lab_name"]).select("row_seq", "doc", "date", "lab_name")


@query
def outliers_3sigma(spark, sf_dir):
    return integrity.outliers(obs(spark, sf_dir)).select("row_seq", "lab_name", "value")


@query
def unit_inconsistency(spark, sf_dir):
    return integrity.unit_inconsistency(obs(spark, sf_dir))


@query
def integrity_violations(spark, sf_dir):
    rows = obs(spark, sf_dir).select("row_seq", F.expr("CASE WHEN row_seq % 50 <> 0 THEN date END").alias("date"), "lab_name", F.expr("CASE row_seq % 4 WHEN 0 THEN '%' WHEN 1 THEN 'boolean' ELSE 'mg/dL' END").alias("lab_unit"), "value")
    return integrity.integrity_violations(rows, "row_seq").groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query
def spec_schema_violations(spark, sf_dir):
    return spec_violations(specs(spark))


# ---- review and reports -----------------------------------------------------------------------------
def _decided(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN toxic = 1 THEN ' Rejected' WHEN quality = 1 THEN 'accepted' END AS review_status")
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")


@query
def review_summary(spark, sf_dir):
    rows = _decided(spark, sf_dir)
    markers = rows.filter("doc_id % 97 = 0").select("source")
    return review.review_summary(rows, ["source"], markers)


@query
def document_summary(spark, sf_dir):
    rows = _decided(spark, sf_dir)
    return review.document_summary(rows, F.col("n_chars") > 1000, F.col("lang") != "en", F.col("review_status"), "source")


def _reasons(spark, sf_dir):
    return obs(spark, sf_dir).withColumn("review_reason", F.expr("CASE WHEN value > 80 THEN 'IMPOSSIBLE_VALUE; ' ELSE '' END || CASE WHEN k > 5 THEN 'TEMPORAL_ANOMALY; ' ELSE '' END || CASE WHEN row_seq % 9 = 0 THEN 'DUPLICATE_ENTRY; ' ELSE '' END"))


@query
def reason_codes_explode(spark, sf_dir):
    return review.reason_counts(_reasons(spark, sf_dir))


@query
def corpus_report(spark, sf_dir):
    rows = _reasons(spark, sf_dir).withColumn("reason", F.explode(T.reason_codes(T.append_reason(F.col("review_reason"), F.col("value") < 5, "NEGATIVE_VALUE"))))
    return rows.groupBy("lab_name", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


def _flagged(spark, sf_dir):
    return _reasons(spark, sf_dir).withColumns({"is_out_of_reference": F.expr("CASE WHEN k <> 3 THEN value > 70 END"), "is_out_of_optimal_range": F.col("value") > 50, "review_needed": F.col("review_reason") != "", "review_status": F.expr("CASE row_seq % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN '' END"), "source_file": F.col("doc").cast("string"), "page_number": F.col("row_seq") % 5, "result_index": F.col("row_seq")})


@query
def summary_cards(spark, sf_dir):
    return explore.summary_cards(_flagged(spark, sf_dir))


@query
def explorer_filter_sort(spark, sf_dir):
    rows = explore.explore(_flagged(spark, sf_dir), ["row_seq"], labs=["Blood - view", "Blood - click"], review="Needs Review")
    return explore.sort_by(rows, "value", True).select("row_seq", "lab_name", "date", "value")


@query
def latest_by_pill(spark, sf_dir):
    return explore.pill_counts(_flagged(spark, sf_dir), ["row_seq"], ("All", "Unreviewed", "Abnormal", "Suboptimal", "Accepted", "Rejected"))


@query
def next_pending(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    current = rows.groupBy("source_file").agg(F.min_by(F.struct("page_number", "result_index"), "row_seq").alias("c")).select("source_file", "c.*")
    return review.next_pending(rows, current).select("source_file", "page_number", "result_index")


@query
def review_queue(spark, sf_dir):
    return review.queue(_flagged(spark, sf_dir), True).select("source_file", "page_number", "result_index", F.col("position").cast("long").alias("position"))


@query
def latest_decisions(spark, sf_dir):
    log = read(spark, sf_dir, "events").selectExpr("'u' || user_id AS source_file", "CAST(user_id % 3 AS INT) AS page_number", "CAST(event_id % 5 AS INT) AS result_index", "CASE event_type WHEN 'view' THEN 'accepted' WHEN 'error' THEN 'REJECTED' END AS status", "lpad(CAST(event_id AS STRING), 12, '0') AS decided_at")
    return review.latest_decisions(log)


@query
def export_projection(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumns({"lab_name": F.expr("CASE row_seq % 6 WHEN 0 THEN '$UNKNOWN$' WHEN 1 THEN NULL ELSE lab_name END"), "raw_value": F.concat(F.lit("r"), F.col("k").cast("string"))})
    return review.export(review.exportable(rows)).select("date", "lab_name", "value", "lab_unit", "source_file", "page_number", "result_index", "review_needed", "review_reason", "raw_value", "lab_type")


@query
def publish_accepted(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumns({"lab_unit_standardized": F.col("lab_unit"), "primary_unit": F.lit("g/L")})
    return review.publish(rows, ["row_seq"]).select("date", "lab_name", "value", "lab_unit", "result_index", "review_needed", "review_reason")


@query
def mode_reference(spark, sf_dir):
    return explore.reference_mode(read(spark, sf_dir, "orders").selectExpr("o_orderpriority", "o_custkey % 20 AS low"), ["o_orderpriority"], "low")


@query
def plot_series(spark, sf_dir):
    return explore.plot_series(obs(spark, sf_dir), "Blood - view").select("row_seq", "date", "value")


# ---- pages and documents ------------------------------------------------------------------------------
SECTION_WORDS = ("Cor", "pH", "Glicose", "LEUCÓCITOS", "other", "Nitritos")


def _turns(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, SECTION_WORDS)), (F.col("turn") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.lit(1).alias("page_number"), F.col("turn").alias("result_index"), names.alias("raw_lab_name"), F.when(F.col("turn") % 4 == 0, "given").alias("raw_section_name"), "role")


@query
def section_backfill(spark, sf_dir):
    return standardize.backfill_sections(_turns(spark, sf_dir)).select("source_file", "result_index", "raw_lab_name", "raw_section_name")


@query
def companion_variants(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumns({"raw_value": F.when(F.col("role") == "user", "Negativo").otherwise("12"), "raw_lab_unit": F.when(F.col("role") == "user", None).otherwise("mg/dL"), "raw_lab_name": F.lit("Glicose")})
    return standardize.companion_names(rows, ["source_file", "page_number", "raw_lab_name"]).select("source_file", "result_index", "lookup_name")
