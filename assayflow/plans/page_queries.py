"""Registered queries over pages, review work, snapshots and specifications. ``page_oracles`` has the same results as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.functions import dates, numeric, text as T
from assayflow.operators import explore, normalize, refresh, reports, review, standardize
from assayflow.operators.specs import Specs
from assayflow.plans import lab, rebuild
from assayflow.plans.queries import NAME_CACHE, QUERIES, _flagged, obs, query, raw_text, read, specs, values
from assayflow.sources import pages, repair, snapshots
from assayflow.sources.sinks import scratch_path


# ---- pages from conversations ------------------------------------------------------------------------
def _page_files(spark, sf_dir) -> DataFrame:
    """``path, stem, page, text``: two turns of a conversation are a page, as a JSON document."""
    turn, n = F.col("turn"), F.length("text")
    result = F.struct(
        F.when(turn % 7 == 5, "raw_value: 1").otherwise(F.concat("role", F.lit(" "), (n % 9).cast("string"))).alias("raw_lab_name"), F.when(n % 4 > 0, n.cast("string")).alias("raw_value"),
        F.when(turn % 3 == 0, "accepted").when(turn % 3 == 1, "Rejected ").alias("review_status"), F.when(n % 2 == 0, (n % 500).cast("double")).alias("bbox_left"), F.lit(3.0).alias("bbox_top"),
        F.when(n % 2 == 0, (n % 500 + F.when(n % 6 == 0, 20).otherwise(300)).cast("double")).alias("bbox_right"), F.lit(400.0).alias("bbox_bottom"), (n % 5 == 0).alias("review_needed"),
    )
    grouped = read(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(turn / 2).alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n"), result.alias("r")))), lambda x: x["r"]).alias("lab_results"))
    failed = (F.col("conv_id") + F.col("p")) % 11 == 0
    payload = F.struct(
        F.when((F.col("conv_id") + F.col("p")) % 4 == 0, "03/02/2024").when((F.col("conv_id") + F.col("p")) % 4 == 1, "0000-00-00").alias("collection_date"), F.when(F.col("conv_id") % 3 == 0, "2023-01-09").alias("report_date"),
        failed.alias("_extraction_failed"), F.when(failed & (F.col("p") % 2 == 0), "unreadable").alias("_failure_reason"), F.when(failed & (F.col("conv_id") % 2 == 0), F.array().cast(dict(grouped.dtypes)["lab_results"])).otherwise(F.col("lab_results")).alias("lab_results"),
        F.when(F.col("conv_id") % 5 == 0, F.array(F.struct(F.col("p").cast("int").alias("anchor_result_index"), F.lit("t").alias("created_at")))).alias("review_missing_rows"),
    )
    stem = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 2 == 0, " 2022-12-31").otherwise(""))
    page = (F.col("p") + 1).cast("int")
    return grouped.select(T.page_path(F.concat(F.lit("out/"), stem, F.lit("_0a1b2c3d")), stem, page).alias("path"), stem.alias("stem"), page.alias("page"), F.to_json(payload).alias("text"))


def _pages(spark, sf_dir) -> DataFrame:
    files = _page_files(spark, sf_dir)
    return pages.with_results(files.withColumn("payload", F.from_json("text", pages.PAGE)))


IDENTITY = ["source_file", "page_number", "result_index"]
__all__ = ["QUERIES"]


@query
def page_rows(spark, sf_dir):
    return pages.flatten(_pages(spark, sf_dir)).select(*IDENTITY, "date", "raw_lab_name", "raw_value", "bbox_left", "review_needed", "review_reason")


@query
def page_rows_forward(spark, sf_dir):
    """Decided rows only, whose indices stay; dates carry forward."""
    return pages.flatten(_pages(spark, sf_dir), ["accepted"], forward_only=True).select(*IDENTITY, "date")


@query
def flatten_array_rows(spark, sf_dir):
    """How many rows each document has, and its last index on any page."""
    return pages.flatten(_pages(spark, sf_dir)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max("result_index").cast("long").alias("last"), F.count("raw_value").alias("n_values"))


@query
def document_date_fill(spark, sf_dir):
    return pages.flatten(_pages(spark, sf_dir)).select("source_file", "date").distinct()


@query
def page_failures(spark, sf_dir):
    return pages.failed_pages(_pages(spark, sf_dir))


@query
def page_markers(spark, sf_dir):
    return pages.missing_markers(_pages(spark, sf_dir)).select("source_file", "page_number", "anchor_result_index")


@query
def page_reuse(spark, sf_dir):
    return pages.reusable(_pages(spark, sf_dir))


@query
def page_fallback(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    return rows.select("stem", "page", pages.needs_fallback(rows).alias("again"), pages.malformed(F.col("results")).alias("malformed"))


@query
def page_salvage(spark, sf_dir):
    return _pages(spark, sf_dir).select("stem", "page", F.size(pages.salvage(F.col("results"))).cast("long").alias("n"))


@query
def page_placeholder(spark, sf_dir):
    rows = pages.flatten(pages.with_placeholder(_pages(spark, sf_dir)))
    return rows.filter(F.col("raw_lab_name") == pages.FAILED_NAME).select(*IDENTITY, "raw_comments", "review_reason")


@query
def page_null_values(spark, sf_dir):
    return reports.null_value_pages(_pages(spark, sf_dir)).select("stem", "page", F.round("null_share", 6).alias("null_share"))


def _broken_pages(spark, sf_dir) -> DataFrame:
    """``conv_id, p, text``: pages whose rows are packed, paired, nested, written as text or cut off, one for each message."""
    n = F.length("text")
    name, value, low = F.concat("role", F.lit(" "), (n % 9).cast("string")), n.cast("string"), F.concat((n % 50).cast("string"), F.lit(",5"))
    row = F.format_string('{"raw_lab_name": "%s", "raw_value": %s, "raw_reference_min": "%s"}', name, value, low)
    as_text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shapes = [
        row, as_text(row), F.format_string('[["raw_lab_name", "%s"], ["raw_value", %s], ["raw_reference_min", "%s"]]', name, value, low),
        F.format_string('["raw_lab_name", "%s", "raw_value", %s, "raw_reference_min", "%s"]', name, value, low),
        F.format_string('"raw_lab_name: %s; raw_value: %s, RAW_REFERENCE_MIN = %s |"', name, value, low), F.format_string("[[%s, %s]]", row, row),
        as_text(F.replace(row, F.lit('"'), F.lit("'"))), as_text(F.left(row, F.lit(25))),
    ]
    shape = F.coalesce(*(F.when((n + F.col("turn")) % 8 == i, s) for i, s in enumerate(shapes)))
    grouped = read(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("p")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n"), shape.alias("s")))).alias("m"))
    items = F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["s"]), ", "), F.lit("]"))
    form, page = (F.col("conv_id") + F.col("p")) % 4, lambda x: F.concat(F.lit('{"lab_results": '), x, F.lit("}"))
    text = F.when(form == 1, page(as_text(items))).when(form == 2, page(page(items))).when((form == 3) & (F.col("conv_id") % 5 == 0), F.concat(F.lit('{"lab_results": '), items)).otherwise(page(items))
    return grouped.select("conv_id", "p", text.alias("text"))


@query
def page_repair(spark, sf_dir):
    """Rows out of payloads that no parser takes as they are."""
    found = repair.with_rows(_broken_pages(spark, sf_dir)).select("conv_id", "p", F.posexplode("results").alias("i", "r"))
    return found.select("conv_id", F.col("p").cast("long").alias("p"), F.col("i").cast("long").alias("i"), "r.raw_lab_name", "r.raw_value", "r.raw_reference_min")


@query
def page_renames(spark, sf_dir):
    """Fields renamed and dropped inside the rows of pages."""
    kept = _pages(spark, sf_dir).select("stem", pages.rename_fields(F.col("results"), {"raw_value": "value_text"}, ("bbox_top",)).alias("r"))
    return kept.select("stem", F.inline("r")).groupBy("stem").agg(F.count("value_text").alias("n_values"), F.count("bbox_bottom").alias("n_boxes"))


@query
def page_targets(spark, sf_dir):
    files = _page_files(spark, sf_dir)
    rows = pages.flatten(_pages(spark, sf_dir)).withColumn("source_file", F.when(F.col("result_index") == 1, "other.pdf").otherwise(F.col("source_file")))
    folders = pages.resolve_directories(files.select("stem"), files.filter("page % 2 = 1").select("path").union(files.select(F.replace("path", F.lit("0a1b2c3d"), F.lit("FFFFFFFF")))))
    return pages.with_targets(rows, folders).groupBy("source_file", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def page_status_backfill(spark, sf_dir):
    rows = pages.flatten(_pages(spark, sf_dir)).withColumn("review_status", F.lit("stale")).withColumn("result_index", F.col("result_index") + F.col("page_number") % 2)
    return pages.backfill_statuses(rows, _pages(spark, sf_dir)).select(*IDENTITY, "review_status")


@query
def page_artifacts(spark, sf_dir):
    """What is sent out for a row, read back."""
    sent = pages.artifact_payload(pages.flatten(_pages(spark, sf_dir)))
    back = F.from_json("payload", "source_file string, result_index long, pixel_bbox struct<left:long,top:long,right:long,bottom:long>, row struct<raw_value:string>")
    return sent.withColumn("b", back).select("row_id", "b.source_file", "b.result_index", F.col("b.pixel_bbox.left").alias("left"), F.col("b.pixel_bbox.bottom").alias("bottom"), F.col("b.row.raw_value").alias("raw_value"))


@query
def snapshot_split(spark, sf_dir):
    """Documents to work on and documents to use again."""
    found = _pages(spark, sf_dir)
    documents = found.select("stem").distinct()
    todo, done = snapshots.split_documents(documents, documents.withColumn("has_columns", F.length("stem") % 2 == 0), pages.reusable(found))
    return todo.select("stem", F.lit(True).alias("todo")).union(done.select("stem", F.lit(False)))


# ---- rows of seven operators that take whole tables ---------------------------------------------------
@query
def union_by_name(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    suppliers = read(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_name AS name")
    return snapshots.merge_documents([customers, suppliers]).groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("n"))


def _snapshot_files(spark, sf_dir) -> DataFrame:
    """``path, place, text``: each nation's suppliers as a CSV file, with other columns in other nations, and some lines too long."""
    k, quoted = F.col("s_nationkey"), F.concat(F.lit('"'), "s_name", F.lit(', ""x""\nnext"'))
    acct, name = F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.col("s_name")
    line = F.when(k % 3 == 0, F.concat_ws(",", name, acct, quoted)).when(k % 3 == 1, F.concat_ws(",", quoted, name)).otherwise(F.concat_ws(",", name, acct))
    line = F.concat(line, F.when(F.col("s_suppkey") % 17 == 0, ",more").otherwise(""))
    head = F.when(k % 3 == 0, "s_name,acct,note").when(k % 3 == 1, "note,s_name").otherwise("s_name,acct")
    lines = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(line).alias("lines"))
    return lines.select(F.concat(F.lit("n"), k.cast("string")).alias("path"), k.cast("int").alias("place"), F.concat(head, F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n\n")).alias("text"))


@query
def snapshot_merge(spark, sf_dir):
    """Snapshots with columns of their own as one table."""
    return snapshots.merged_rows(snapshots.parse_snapshots(_snapshot_files(spark, sf_dir))).select("s_name", "acct", "note")


@query
def snapshot_audit(spark, sf_dir):
    return snapshots.snapshot_audit(snapshots.parse_snapshots(_snapshot_files(spark, sf_dir))).select("path", "n_rows", "n_malformed")


# ---- the whole chain ---------------------------------------------------------------------------------
EXPORT_LABS = {
    "Blood - view": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="1-1", biological_max=5000, alternatives=[{"unit": "g/L", "factor": 100.0}]),
    "Blood - click": dict(lab_type="blood", primary_unit="g/L", loinc_code="2-2", max_daily_change=20, alternatives=[{"unit": "mg/dL", "factor": 0.01}]),
}
EXPORTED = ["date", "lab_name", "value", "lab_unit", "source_file", "result_index"]


def _reported(spark, sf_dir) -> tuple[DataFrame, lab.Context]:
    """Events as rows that were read from pages: raw names, values and units, three of four accepted."""
    rows = read(spark, sf_dir, "events").selectExpr(
        "'d' || (user_id % 40) || '.pdf' AS source_file", "1 AS page_number", "CAST(event_id AS INT) AS result_index", "CAST(CAST(ts AS DATE) AS STRING) AS date", "event_type AS raw_lab_name",
        "CAST(NULL AS STRING) AS raw_section_name", "CAST(CAST(value AS DECIMAL(12,2)) AS STRING) AS raw_value", "CASE WHEN event_id % 3 = 0 THEN 'mg/dL' ELSE 'g/L' END AS raw_lab_unit", "CAST(NULL AS STRING) AS raw_reference_range",
        "CAST(NULL AS STRING) AS raw_comments", "CAST(NULL AS DOUBLE) AS raw_reference_min", "CAST(NULL AS DOUBLE) AS raw_reference_max", "false AS review_needed", "CAST(NULL AS STRING) AS review_reason", "CASE WHEN event_id % 4 > 0 THEN 'accepted' END AS review_status",
    )
    names = values(spark, "key string, lab_name string", [("view", "Blood - view"), ("click", "Blood - click")])
    units = values(spark, "key string, unit string", [(f"{u.lower()}|blood - {n}", u) for n in ("view", "click") for u in ("mg/dL", "g/L")])
    return rows, lab.Context(Specs.from_dict(spark, EXPORT_LABS), names, units)


@query
def whole_export(spark, sf_dir):
    """From rows as they were read to the published table."""
    rows, context = _reported(spark, sf_dir)
    return lab.final_export(rows, context).select(*EXPORTED)


def _decisions(rows: DataFrame) -> DataFrame:
    """Two documents decided anew: one gets back what was pending, the other loses two thirds."""
    status = F.when(F.col("source_file") == "d3.pdf", "accepted").when(F.col("result_index") % 3 > 0, "rejected").otherwise("accepted")
    return rows.filter(F.col("source_file").isin("d3.pdf", "d7.pdf")).select(*IDENTITY, status.alias("status"), F.lit("1").alias("decided_at"))


@query
def incremental_export(spark, sf_dir):
    """The published table after decisions on two documents, of which only what they touch is made again."""
    rows, context = _reported(spark, sf_dir)
    standing = rows.filter("review_status is not null").select(*IDENTITY, F.col("review_status").alias("status"), F.lit("0").alias("decided_at"))
    store = rebuild.ExportStore(spark, scratch_path(spark, "export"))
    store.build(rows, context, standing)
    new = _decisions(rows)
    return store.apply(rows, context, standing.unionByName(new), new.select("source_file")).select(*EXPORTED)


@query
def percent_ambiguity(spark, sf_dir):
    rows = obs(spark, sf_dir).select("row_seq", F.col("lab_name").alias("lab_name_standardized"), F.when(F.col("lab_unit") != "g/L", F.col("lab_unit")).alias("raw_lab_unit"), F.when(F.col("k") == 1, 2.0).alias("raw_reference_min"), F.lit(None).cast("double").alias("raw_reference_max"))
    return lab.percent_ambiguity(rows, specs(spark)).filter("percent_ambiguity").select("row_seq", "lab_name_standardized")


@query
def ledger_new(spark, sf_dir):
    """Pages of the second half whose content no page of the first half has."""
    found = read(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("content_hash"))
    return pages.new_contents(found.filter("page_id % 2 = 1"), found.filter("page_id % 2 = 0"))


@query
def stale_difference(spark, sf_dir):
    return snapshots.stale_cases(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


KINDS = [("licence", "license"), ("contact", r"@[a-z0-9]+\."), ("table", r" \| "), ("loud", "!!")]


@query
def categorize_rules(spark, sf_dir):
    return reports.categorize(read(spark, sf_dir, "documents"), "text", KINDS, "prose", ("lang",))


@query
def regression_canonical(spark, sf_dir):
    from assayflow.sources.sinks import canonical_lines

    rows = read(spark, sf_dir, "orders").selectExpr("CAST(o_orderdate AS DATE) AS date", "o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ',\"' ELSE '' END AS lab_name", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus = 'F' END AS flag", "o_orderkey AS result_index")
    return canonical_lines(rows, ["result_index"])


@query
def approved_case_faults(spark, sf_dir):
    cases = read(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS case_id", "CASE WHEN doc_id % 7 > 0 THEN source || (doc_id % 40) END AS stem", "CASE WHEN doc_id % 11 > 0 THEN 'h' END AS file_hash", "lang AS original_filename", "CASE WHEN doc_id % 13 = 0 THEN 'expected.csv' ELSE '' END AS missing")
    return snapshots.case_faults(cases)


# ---- variants of a lab --------------------------------------------------------------------------------
def _variants(spark, sf_dir) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, VARIANT_UNITS)), (F.col("row_seq") % len(VARIANT_UNITS) + 1).cast("int"))
    lab = F.expr("CASE row_seq % 3 WHEN 0 THEN 'Blood - purchase' WHEN 1 THEN 'Blood - purchase (%)' ELSE 'Blood - view' END")
    return obs(spark, sf_dir).select("row_seq", lab.alias("lab_name_standardized"), unit.alias("raw_lab_unit"), F.lit("U").alias("lab_unit_standardized"))


VARIANT_UNITS = ("%", "mg/dL", "percent", " MG/ DL", "x10^3/uL", "odd", " ")


@query
def variant_units(spark, sf_dir):
    rows = standardize.effective_labs(_variants(spark, sf_dir), specs(spark))
    rows = standardize.variant_units(rows, specs(spark), "effective_lab")
    return rows.groupBy("lab_name_standardized", "raw_lab_unit", "effective_lab", "lab_unit_standardized").agg(F.count(F.lit(1)).alias("n"))


RANGED = {
    "Blood - purchase": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="1", ranges={"default": [2, 9]}),
    "Blood - purchase (%)": dict(lab_type="blood", primary_unit="%", loinc_code="2", ranges={"default": [20, 75]}),
    "Blood - Complement CH50": dict(lab_type="blood", primary_unit="U/mL", loinc_code="3"),
    "Blood - Complement C3": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="4", ranges={"default": [50, 90]}),
    "Blood - Complement C4": dict(lab_type="blood", primary_unit="g/L", loinc_code="5", ranges={"default": [10, 40]}),
}


def _ranged(spark, sf_dir, labs: tuple[str, str]) -> DataFrame:
    lab = F.when(F.col("o_orderkey") % 2 == 0, labs[0]).otherwise(labs[1])
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", lab.alias("lab_name_standardized"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'MG/dl' ELSE '' END").alias("raw_lab_unit"), F.lit("U").alias("lab_unit_standardized"),
        F.expr("CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 70 END AS DOUBLE)").alias("raw_reference_min"), F.expr("CAST(CASE WHEN o_custkey % 5 > 1 THEN o_custkey % 90 END AS DOUBLE)").alias("raw_reference_max"),
        F.expr("CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 80) || ',5' ELSE 'x' END").alias("raw_value"),
    )


@query
def missing_unit_from_range(spark, sf_dir):
    rows = standardize.missing_units(_ranged(spark, sf_dir, ("Blood - purchase", "Blood - purchase (%)")), Specs.from_dict(spark, RANGED))
    return rows.select("o_orderkey", "lab_unit_standardized")


@query
def complement_variants(spark, sf_dir):
    rows = standardize.complement_variants(_ranged(spark, sf_dir, ("Blood - Complement CH50", "Blood - purchase")), Specs.from_dict(spark, RANGED))
    return rows.select("o_orderkey", "lab_name_standardized", "lab_unit_standardized")


# ---- steps of normalisation ---------------------------------------------------------------------------
U = "Urine Type II - "
URINE = {
    U + "Sediment - Leukocytes": dict(lab_type="urine", primary_unit="/field", loinc_code="1"), U + "Sediment - Leukocytes (Absolute)": dict(lab_type="urine", primary_unit="/uL", loinc_code="2"),
    U + "Glucose": dict(lab_type="urine", primary_unit="mg/dL", loinc_code="3"), U + "Glucose (Qualitative)": dict(lab_type="urine", primary_unit="boolean", loinc_code="4"),
    "Blood - HIV": dict(lab_type="blood", primary_unit="boolean", loinc_code="5"),
}


def _urine(spark, sf_dir) -> DataFrame:
    """Raw values as results of four labs, in sections by turns."""
    lab = F.element_at(F.array(*(F.lit(x) for x in (U + "Sediment - Leukocytes", U + "Sediment - Crystals", U + "Glucose", "Blood - HIV"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    section = F.element_at(F.array(*map(F.lit, ("Sedimento", "TIPO II", "", "Elementos anormais"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    unit = F.when(F.col("l_returnflag") == "A", "/uL").when(F.col("l_returnflag") == "N", "boolean")
    comment = F.when(F.col("l_orderkey") % 6 == 0, "Positivo").when(F.col("l_orderkey") % 6 == 1, "x")
    rows = raw_text(spark, sf_dir).select("l_orderkey", "l_linenumber", "raw_value", lab.alias("lab_name_standardized"), section.alias("raw_section_name"), unit.alias("lab_unit_standardized"), comment.alias("raw_comments"))
    return normalize.preprocess_values(rows)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lab_name_standardized", "lab_unit_standardized").agg(F.count(F.lit(1)).alias("n"), F.count("value_primary").alias("n_values"), F.sum(F.col("value_primary").cast("decimal(20,3)")).alias("total"))


@query
def sediment_units(spark, sf_dir):
    return _summed(normalize.absolute_sediment(normalize.field_style_units(_urine(spark, sf_dir)), Specs.from_dict(spark, URINE)))


@query
def qualitative_rows(spark, sf_dir):
    return _summed(normalize.qualitative_rows(_urine(spark, sf_dir), Specs.from_dict(spark, URINE)))


@query
def strip_values(spark, sf_dir):
    return _summed(normalize.strip_values(_urine(spark, sf_dir), Specs.from_dict(spark, URINE)))


@query
def qualitative_values(spark, sf_dir):
    return _summed(normalize.qualitative_values(_urine(spark, sf_dir), Specs.from_dict(spark, URINE)))


@query
def qualitative_aliases(spark, sf_dir):
    rows = _urine(spark, sf_dir).withColumns({"raw_lab_unit": F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 'mg/dL' END"), "lab_name_standardized": F.when(F.col("l_linenumber") == 2, U + "Glucose (Qualitative)").otherwise(F.col("lab_name_standardized"))})
    return standardize.qualitative_aliases(rows, Specs.from_dict(spark, URINE)).groupBy("lab_name_standardized", "raw_lab_unit").agg(F.count(F.lit(1)).alias("n"))


# ---- specifications -----------------------------------------------------------------------------------
def _part_specs(spark, sf_dir) -> Specs:
    """Parts as labs: a fifth qualitative by name, two fifths boolean, some without a unit or a code."""
    name = "'Blood - ' || p_name || ' ' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN ' (Qualitative)' ELSE '' END AS lab_name"
    parts, none = read(spark, sf_dir, "part"), Specs.from_dict(spark, {})
    spec = parts.selectExpr(
        name, "'blood' AS lab_type", "CASE WHEN p_partkey % 5 < 2 THEN 'boolean' WHEN p_partkey % 7 > 0 THEN p_type END AS primary_unit", "CASE WHEN p_partkey % 4 > 0 THEN p_size || '-' || (p_partkey % 10) END AS loinc_code",
        "CAST(NULL AS DOUBLE) AS biological_min", "CAST(NULL AS DOUBLE) AS biological_max", "CAST(NULL AS DOUBLE) AS max_daily_change", "CAST(NULL AS BOOLEAN) AS ranges_vary_with_cycle",
    )
    factors = parts.selectExpr(name, "0 AS pos", "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS unit", "CAST(p_size AS DOUBLE) AS factor")
    return Specs(spec, factors, none.spec_range, none.relationship)


@query
def spec_aliases(spark, sf_dir):
    """Every name that a lab goes by, with its code."""
    s = _part_specs(spark, sf_dir)
    return s.aliases().join(s.codes(), "alias").select("alias", "lab_name", "loinc_code")


@query
def spec_units(spark, sf_dir):
    s = _part_specs(spark, sf_dir)
    return s.units().select(F.lit("unit").alias("kind"), F.col("unit").alias("name")).union(s.names().select(F.lit("lab"), "lab_name"))


@query
def spec_factors(spark, sf_dir):
    return _part_specs(spark, sf_dir).factors()


@query
def unconverted_units(spark, sf_dir):
    rows = obs(spark, sf_dir).select(F.expr("CASE WHEN row_seq % 9 = 0 THEN '$UNKNOWN$' ELSE lab_name END").alias("lab_name_standardized"), F.expr("CASE WHEN row_seq % 5 = 0 THEN '%' ELSE lab_unit END").alias("lab_unit_standardized"))
    return reports.units_without_conversion(rows, specs(spark))


@query
def repeated_codes(spark, sf_dir):
    return reports.codes_of_several_labs(_part_specs(spark, sf_dir)).select("loinc_code", F.array_join("labs", "|").alias("labs"))


# ---- caches -------------------------------------------------------------------------------------------
def _named(spark, sf_dir) -> DataFrame:
    section = F.expr("CASE WHEN c_nationkey % 4 = 0 THEN 'Seccao 0' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Section ' || (c_nationkey % 4) END")
    name = F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END")
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("raw_lab_name"), section.alias("raw_section_name"), F.expr("CASE c_custkey % 3 WHEN 0 THEN ' Mg/L' WHEN 1 THEN 'g' END").alias("raw_lab_unit"))


@query
def missing_names(spark, sf_dir):
    return refresh.missing_names(_named(spark, sf_dir), values(spark, "key string, lab_name string", NAME_CACHE), "c_custkey")


UNIT_CACHE = [("mg/l|blood - building", "mg/L"), ("null|blood - machinery", "U"), ("bad", "x"), ("g|", "g"), ("g|x", "$UNKNOWN$")]


@query
def missing_units(spark, sf_dir):
    return refresh.missing_units(_named(spark, sf_dir), values(spark, "key string, lab_name string", NAME_CACHE), values(spark, "key string, unit string", UNIT_CACHE))


@query
def pruned_units(spark, sf_dir):
    cache = read(spark, sf_dir, "part").selectExpr("lower(p_brand) || CASE WHEN p_size % 3 > 0 THEN '|' ELSE '' END || CASE WHEN p_size % 4 > 0 THEN lower(p_type) ELSE '' END AS key", "CASE WHEN p_size % 5 = 0 THEN '$UNKNOWN$' ELSE 'u' END AS unit").distinct()
    return refresh.prune_unknown(cache, "unit", True)


@query
def accepted_answers(spark, sf_dir):
    """Of a mapper's answers, those that were asked for and that the vocabulary has."""
    names = read(spark, sf_dir, "part").select(F.lower("p_brand").alias("key"), F.expr("'L' || (p_size % 7)").alias("lab_name"))
    asked = names.filter("key like '%3%'").select("key").distinct()
    return refresh.answered(asked, names, values(spark, "lab_name string", [("L1",), ("L3",), ("L9",)]), "lab_name")


@query
def unknown_report(spark, sf_dir):
    rows = obs(spark, sf_dir).selectExpr("CASE row_seq % 7 WHEN 0 THEN '$UNKNOWN$' ELSE lab_name END AS lab_name_standardized", "CASE row_seq % 5 WHEN 0 THEN '$UNKNOWN$' ELSE lab_unit END AS lab_unit_standardized", "CASE WHEN row_seq % 11 > 0 THEN lab_name END AS raw_lab_name", "lab_unit AS raw_lab_unit", "CASE WHEN k > 4 THEN 'blood' ELSE 'urine' END AS lab_type")
    return reports.unknown_counts(rows)


@query
def unknown_shares(spark, sf_dir):
    rows = obs(spark, sf_dir).selectExpr("CASE row_seq % 7 WHEN 0 THEN '$UNKNOWN$' ELSE lab_name END AS lab_name_standardized", "CASE row_seq % 5 WHEN 0 THEN '$UNKNOWN$' ELSE lab_unit END AS lab_unit_standardized", "lab_name AS raw_lab_name", "lab_unit AS raw_lab_unit")
    shares = reports.unknown_shares(rows)
    return shares.select(*(F.round(c, 9).alias(c) for c in ("unknown_labs", "unknown_units")), "distinct_labs", "distinct_units")


@query
def corpus_counts(spark, sf_dir):
    return reports.corpus_counts(_flagged(spark, sf_dir))


@query
def corpus_rollup(spark, sf_dir):
    """The same counts in each document and over all of them."""
    return reports.corpus_rollup(_flagged(spark, sf_dir))


@query
def batch_flags(spark, sf_dir):
    rows = obs(spark, sf_dir).select("row_seq")
    found = obs(spark, sf_dir).filter("value > 60").selectExpr("row_seq", "'HIGH' AS code").union(obs(spark, sf_dir).filter("k = 3").selectExpr("row_seq", "'THREE' AS code"))
    return reports.with_flags(rows, found.union(found), ["row_seq"], ["HIGH", "THREE"])


# ---- review work --------------------------------------------------------------------------------------
def _requests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    asked = read(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 17 > 0 THEN ' d' || (user_id % 50) END AS source_file", "CASE WHEN event_id % 13 > 0 THEN CAST(event_id % 4 AS DOUBLE) ELSE 1.5D END AS page_number",
        "CASE event_id % 6 WHEN 5 THEN '-1' WHEN 4 THEN ' 2 ' WHEN 3 THEN '1.0' ELSE CAST(event_id % 9 AS STRING) END AS result_index", "CASE event_type WHEN 'view' THEN ' Accept' WHEN 'click' THEN 'REJECT' WHEN 'error' THEN 'missing_row' WHEN 'signup' THEN 'clear' ELSE 'buy' END AS action",
    )
    sizes = spark.range(150).selectExpr("'d' || (id % 50) AS source_file", "CAST(id DIV 50 AS BIGINT) AS page_number", "CAST(id % 7 AS BIGINT) AS n_results")
    return asked, sizes


@query
def judged_requests(spark, sf_dir):
    return review.judge_requests(*_requests(spark, sf_dir)).select("event_id", *IDENTITY, "action", "refused")


@query
def decision_log(spark, sf_dir):
    judged = review.judge_requests(*_requests(spark, sf_dir))
    at = review.utc_text(F.timestamp_seconds(F.col("event_id") * 100))
    made = review.decisions_of(judged, at).select(*IDENTITY, "status", "decided_at")
    return made.union(review.markers_of(judged, at).select("source_file", "page_number", "anchor_result_index", F.lit(None).cast("string"), "created_at"))


def _summary(spark, sf_dir) -> DataFrame:
    rows = _flagged(spark, sf_dir).withColumn("review_status", F.when(F.col("doc") % 3 == 0, "accepted").otherwise(F.col("review_status")))
    return review.review_summary(rows, ["source_file"], rows.filter("doc % 5 = 0 and k = 1").select("source_file"))


@query
def unready_documents(spark, sf_dir):
    return review.unready(_summary(spark, sf_dir))


@query
def document_choices(spark, sf_dir):
    return review.document_choices(review.filter_documents(_summary(spark, sf_dir), "Not Fixture Ready"))


@query
def ready_documents(spark, sf_dir):
    return review.filter_documents(_summary(spark, sf_dir), "Fixture Ready").select("source_file", "reviewed")


@query
def initial_document(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return review.initial_document(review.document_summary(rows, F.col("value") > 50, F.col("review_needed"), F.col("review_status")))


@query
def next_in_corpus(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return review.next_in_corpus(rows).select(*IDENTITY, F.lit(False).alias("needed")).union(review.next_in_corpus(rows, True).select(*IDENTITY, F.lit(True)))


@query
def row_moves(spark, sf_dir):
    view = review.numbered(_flagged(spark, sf_dir), explore.sort_keys(document=True), ["source_file"])
    return review.moves(view, ["source_file"]).select("row_seq", *(F.col(c).cast("long").alias(c) for c in ("position", "previous", "next")))


@query
def resolved_position(spark, sf_dir):
    rows = _flagged(spark, sf_dir).filter("lab_name = 'Blood - view'").withColumn("token", T.row_token(F.col("source_file"), F.col("page_number"), F.col("result_index")))
    view = review.numbered(rows, ["row_seq"])
    some = '["nobody",1,1]'
    cases = [(review.resolve_position(view, [some]), "none"), (review.resolve_position(view, [some], 10**9), "end"), (review.resolve_position(view.filter("position >= 3"), []), "empty tokens")]
    frames = [f.select(F.lit(name).alias("kind"), "position") for f, name in cases]
    third = review.select_row(view, 3).select(F.lit("selected").alias("kind"), F.col("row_seq").alias("position"))
    return frames[0].union(frames[1]).union(frames[2]).union(third)


@query
def queue_display(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumns({"raw_lab_name": F.concat(F.lit("<"), "lab_name", F.lit(">&")), "raw_value": F.when(F.col("k") > 2, F.lit(" a'b\" ")).otherwise(" ")})
    return review.queue_display(review.queue(rows), 2).withColumn("position", F.col("position").cast("long"))


@query
def row_context(spark, sf_dir):
    rows = _flagged(spark, sf_dir).filter("lab_name = 'Blood - click'").withColumns({"reference_min": F.when(F.col("k") > 4, 1.5), "reference_max": F.when(F.col("k") % 2 == 0, 9.0)})
    view = review.numbered(rows, ["row_seq"])
    frames = [explore.row_context(view, p).select(F.col("position").cast("long").alias("position"), "position_text", "selected_ref.min", "selected_ref.max", "plot_lab") for p in (0, 4, 11)]
    return frames[0].union(frames[1]).union(frames[2])


@query
def display_table(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumns({"reference_min": F.lit(1.0), "reference_max": F.when(F.col("k") > 4, 9.0), "source_file": F.concat("source_file", F.lit(".scan.pdf"))})
    wanted = ["page_number", "value", "date", "nothing", "review_status", "reference_range", "source_document", "raw_value"]
    return explore.display(rows, wanted, labels=False).drop("value")


@query
def lab_choices(spark, sf_dir):
    rows = obs(spark, sf_dir).selectExpr("CASE row_seq % 4 WHEN 0 THEN '$UNKNOWN$' WHEN 1 THEN ' ' ELSE lab_name END AS lab_name")
    return explore.lab_choices(rows)


# ---- scalar functions ---------------------------------------------------------------------------------
@query
def age_years(spark, sf_dir):
    day = F.expr("date_add(CAST(o_orderdate AS DATE), CAST(o_custkey AS INT))")
    return read(spark, sf_dir, "orders").select("o_orderkey", numeric.age_on(F.col("o_orderdate").cast("date"), day).cast("long").alias("age"))


@query
def numeric_fields(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 6 WHEN 0 THEN o_custkey || ',5' WHEN 1 THEN ' ' || o_custkey || '.25 ' WHEN 2 THEN o_custkey || ', comments: ok' WHEN 3 THEN 'x' WHEN 4 THEN '' END")
    return read(spark, sf_dir, "orders").select("o_orderkey", numeric.numeric_field(text).alias("number"))


@query
def range_texts(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 7 WHEN 0 THEN o_custkey || '-' || (o_custkey + 5) WHEN 1 THEN ' 1.5 - 2 ' WHEN 2 THEN 'Negative' WHEN 3 THEN 'present' WHEN 4 THEN '12' WHEN 5 THEN 'n/a' END")
    r = numeric.parse_range(text, F.col("o_custkey") % 2 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", r["min"].alias("low"), r["max"].alias("high"))


@query
def clean_boxes(spark, sf_dir):
    box: list[Column] = [F.expr(e) for e in ("CAST(p_size AS STRING)", "CASE WHEN p_size % 5 = 0 THEN 'nan' ELSE '3,5' END", "' 400 '", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE '9.25' END")]
    cleaned = numeric.clean_box(box)
    rows = read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(cleaned, ("left", "top", "right", "bottom"))))
    return rows.withColumn("valid", numeric.valid_box(*(F.col(c) for c in ("left", "top", "right", "bottom"))))


@query
def text_marks(spark, sf_dir):
    """What sections, units and names look like, by the words of documents' sources."""
    word = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % len(MARKS) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    w = F.col("word")
    return rows.select("word", "n", T.is_strip_section(w).alias("strip"), T.is_sediment_section(w).alias("sediment"), T.unit_looks_percent(w).alias("percent"), T.unit_looks_absolute(w).alias("absolute"), T.has_field_label(w).alias("label"), T.blank_like(w).alias("blank"), T.document_label(w).alias("document"), dates.name_date(w).alias("day"), T.collapse_spaced_letters(w).alias("spaced"))


MARKS = ("Elementos anormais", "EXAME MICROSCOPICO DO SEDIMENTO", "% do total", "x 10^3/uL", "10e9/L", "v.abs.", "raw_value: 5", " NaN ", "a.b.pdf", "report 2024-02-03.pdf", "H E M A", "percentagem", "/mm3", "n/a")


@query
def html_texts(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    text = F.when(F.col("k") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("<a href='x'>\""), "lab_name", F.lit("\" & co</a>")))
    template = T.fill_template(F.lit("{name}: {n} of {unknown}"), name=F.col("lab_name"), n=F.col("k"))
    return rows.select(T.html_text(text).alias("html"), T.reason_chips(F.col("review_reason")).alias("chips"), template.alias("filled"), T.status_label(F.col("review_status")).alias("status")).groupBy("html", "chips", "filled", "status").agg(F.count(F.lit(1)).alias("n"))


FAULTS = ("HTTP 401", "Forbidden", "Request TIMEOUT 404", "404 page", "invalid model", "Connection closed", "name or Service not known", "BadRequest", "no Permission", "teapot", "reset by peer")


@query
def service_faults(spark, sf_dir):
    message = F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("event_id") % len(FAULTS) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").groupBy(message.alias("message")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("fault", T.service_fault(F.col("message")))


@query
def fenced_texts(spark, sf_dir):
    """Answers in a fence, bare, in a fence that has no line below it, in one that nothing closes, and cut off."""
    answer = F.expr(
        """CASE doc_id % 5 WHEN 0 THEN '```json\n{"a": ' || doc_id || '}\n ``` ' WHEN 1 THEN ' [' || doc_id || '] ' WHEN 2 THEN '```' || doc_id
        WHEN 3 THEN '```\n' || doc_id || '\n' ELSE '{"a": ' || doc_id END"""
    )
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_fences(answer).alias("inner"), T.json_or(answer, F.lit("[]")).alias("json"))


@query
def document_paths(spark, sf_dir):
    """The files of each page's document, whose folder has a hash or not, and a source file or not."""
    files = _page_files(spark, sf_dir)
    kind = F.length("stem") % 3
    folder = F.concat("stem", F.when(kind == 0, "_0a1b2C3d").when(kind == 1, "_0a1b2c3").otherwise(""))
    stem = T.folder_stem(folder, F.when(F.col("page") % 2 == 0, F.concat(F.lit("scan "), "stem", F.lit(".1.pdf"))))
    directory = F.concat(F.lit("out/"), folder)
    return files.select("stem", "page", T.document_csv_path(directory, stem).alias("csv"), T.page_path(directory, stem, F.col("page")).alias("json"), T.page_path(directory, stem, F.col("page"), ".jpg").alias("image"))


@query
def legacy_moves(spark, sf_dir):
    """Folders for every document, some named with a hash, some with both names; one stem in ten has two files."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")).alias("stem"), F.sha2("text", 256).alias("content_hash"))
    whole, kind = F.concat_ws("_", "stem", F.substring("content_hash", 1, 8)), F.col("doc_id") % 4
    names = F.when(kind == 0, F.array("stem")).when(kind == 1, F.array(whole)).when(kind == 2, F.array("stem", whole)).otherwise(F.array(F.concat("stem", F.lit("x")), F.col("stem")))
    sources = docs.filter("doc_id % 7 > 0").select(F.concat("stem", F.lit(".pdf")).alias("name"), "content_hash")
    return pages.legacy_moves(docs.select(F.explode(names).alias("folder")), sources)
