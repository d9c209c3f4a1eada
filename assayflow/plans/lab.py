"""From page documents to a reviewed table: the whole plan, as a chain of DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayflow.functions import numeric, text as T
from assayflow.operators import normalize, refresh, review, standardize, validate
from assayflow.operators.specs import PERCENT, Specs, demographic_ranges, lookup
from assayflow.sources import pages
from assayflow.sources.sinks import materialize

ORDER = ["source_file", "page_number", "result_index"]


@dataclass(frozen=True)
class Context:
    """Dimension tables that a run needs."""

    specs: Specs
    name_cache: DataFrame
    unit_cache: DataFrame


def read_rows(spark: SparkSession, root: str, statuses: list[str] | None = None) -> DataFrame:
    return pages.flatten(pages.with_results(pages.read_pages(spark, root)), statuses)


def with_public_names(rows: DataFrame) -> DataFrame:
    """The names that the export uses."""
    return rows.withColumns({
        "lab_name": F.col("lab_name_standardized"), "value": F.col("value_primary"), "lab_unit": F.col("lab_unit_primary"), "reference_min": F.col("reference_min_primary"),
        "reference_max": F.col("reference_max_primary"), "raw_unit": F.col("raw_lab_unit"),
    })


def percent_ambiguity(rows: DataFrame, specs: Specs, out: str = "percent_ambiguity") -> DataFrame:
    """A lab with a ``(%)`` sibling whose raw unit tells neither a share nor a count, so that the sibling can't be ruled out."""
    with_share = lookup(rows, specs.siblings(), "lab_name_standardized", "lab_name", _share="percent_name")
    both = lookup(with_share, specs.siblings(), "lab_name_standardized", "percent_name", _count="lab_name")
    unit = F.col("raw_lab_unit")
    told = T.unit_looks_percent(unit) | T.unit_looks_absolute(unit) | (F.trim(F.coalesce(unit, F.lit(""))) != "")
    sibling = F.col("_share").isNotNull() | F.col("_count").isNotNull()
    ranged = F.col("raw_reference_min").isNotNull() | F.col("raw_reference_max").isNotNull()
    return both.withColumn(out, sibling & ~told & ~ranged & ~F.col("lab_name_standardized").endswith(PERCENT)).drop("_share", "_count")


def normalized_rows(rows: DataFrame, context: Context, mode: str) -> DataFrame:
    """Review rows with standard names and primary values, before the checks on values. Each document's rows depend on that document alone."""
    if mode not in ("review", "export"):
        raise ValueError(f"mode is review or export, not {mode!r}")
    specs, review_mode = context.specs, mode == "review"
    rows = standardize.backfill_sections(rows)
    rows = materialize(standardize.standardize(rows, specs, context.name_cache, context.unit_cache), "standardized")
    rows = percent_ambiguity(validate.unknown_mappings(rows), specs)
    rows = with_public_names(normalize.normalize(rows, specs).withColumn("date", F.col("date").try_cast("date")))
    rows = validate.suspicious_range(rows, specs)
    codes = {"unknown_lab": "UNKNOWN_LAB_MAPPING", "unknown_unit": "UNKNOWN_UNIT_MAPPING", "percent_ambiguity": "AMBIGUOUS_PERCENTAGE_VARIANT", "suspicious_range": "SUSPICIOUS_REFERENCE_RANGE"}
    reason = T.append_reasons(F.col("review_reason"), [(F.col(flag), code) for flag, code in codes.items()])
    flagged = F.coalesce("review_needed", F.lit(False))
    for flag in codes:
        flagged = flagged | F.col(flag)
    rows = rows.withColumns({"review_reason": reason, "review_needed": flagged}).drop(*codes)
    if not review_mode:
        rows = review.exportable(rows)
    return rows


def checked_rows(rows: DataFrame, context: Context, mode: str) -> DataFrame:
    return validate.validate(rows, context.specs, ["source_file"] if mode == "review" else [], ORDER)


def prepare_rows(rows: DataFrame, context: Context, mode: str) -> DataFrame:
    """Review rows with standard names, primary values and flags. ``mode`` is 'review' (checks within a document) or 'export' (within the corpus).

    The plan is cut twice by a written table: the checks join the rows with what they find in them, and would
    else repeat all of the lookups before them, in planning and in running.
    """
    return checked_rows(materialize(normalized_rows(rows, context, mode), "normalized"), context, mode)


def review_ledger(rows: DataFrame, context: Context, decisions: DataFrame | None = None) -> DataFrame:
    """All rows under review, with the latest decisions."""
    out = prepare_rows(rows, context, "review")
    return out if decisions is None else review.with_decisions(out, decisions)


def final_export(rows: DataFrame, context: Context, decisions: DataFrame | None = None, allow_pending: bool = False) -> DataFrame:
    """The published table. Decisions count before checks, so a rejected row flags no other."""
    return published(prepare_rows(decided_rows(rows, decisions, allow_pending), context, "export"), context)


def decided_rows(rows: DataFrame, decisions: DataFrame | None, allow_pending: bool = False) -> DataFrame:
    if decisions is not None:
        rows = review.with_decisions(rows, decisions)
    return rows if allow_pending else rows.filter(T.persisted_status(F.col("review_status")) == "accepted")


def published(checked: DataFrame, context: Context) -> DataFrame:
    return review.publish(lookup(checked, context.specs.spec, "lab_name", "lab_name", primary_unit="primary_unit"), ORDER, allow_pending=True)


def apply_requests(rows: DataFrame, context: Context, log: DataFrame, markers: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Carry out ``requests(row_id, action)`` by opaque ids: the log and the markers with their entries, what was refused, and the export rebuilt.

    Both logs only grow: the state of a row is its last entry.
    """
    asked = requests.withColumn("_id", T.decode_row_id(F.col("row_id"))).select("row_id", "action", *(F.col(f"_id.{c}").alias(c) for c in review.IDENTITY))
    sizes = rows.groupBy("source_file", "page_number").agg((F.max("result_index") + 1).alias("n_results"))
    judged = review.judge_requests(asked, sizes)
    log = log.unionByName(review.decisions_of(judged, at), allowMissingColumns=True)
    markers = markers.unionByName(review.markers_of(judged, at))
    return log, markers, judged.filter("refused is not null").select("row_id", "action", "refused"), final_export(rows, context, log)


def refresh_and_export(rows: DataFrame, context: Context, names: refresh.Mapper, units: refresh.Mapper, export: Callable[[DataFrame, Context], DataFrame] = final_export) -> tuple[DataFrame, Context]:
    """The export, built again only if the mappers' answers have made a cache grow."""
    first = export(rows, context)
    keyed = rows.withColumn("_row", F.struct(*ORDER))
    new_names, new_units, grown = refresh.refresh(keyed, context.name_cache, context.unit_cache, context.specs, names, units, "_row")
    if not grown:
        return first, context
    context = Context(context.specs, materialize(new_names, "names"), materialize(new_units, "units"))
    return export(rows, context), context


def strict_export(rows: DataFrame, context: Context, decisions: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """``final_export`` of documents that are all reviewed; raises where rows are pending or marked as missing."""
    decided = rows if decisions is None else review.with_decisions(rows, decisions)
    review.ensure_ready(review.review_summary(decided, ["source_file"], markers))
    return final_export(decided, context)


def explorer_view(rows: DataFrame, context: Context, sex: str | None = None, age: int | None = None) -> DataFrame:
    """Rows with what the explorer shows: abnormal by the report's bounds, suboptimal by the range for the reader's sex and age."""
    spark = rows.sparkSession
    reader = spark.createDataFrame([(0, sex, age)], "reader int, sex string, age int")
    ranges = demographic_ranges(reader, context.specs.spec_range)
    joined = lookup(rows, ranges, "lab_name", "lab_name", optimal_min="range_min", optimal_max="range_max")
    v = F.col("value")
    return joined.withColumns({
        "is_out_of_reference": numeric.abnormal(v, F.col("reference_min"), F.col("reference_max"), F.col("lab_unit") == "boolean"),
        "is_out_of_optimal_range": numeric.suboptimal(v, F.col("optimal_min"), F.col("optimal_max")),
        "reference_text": numeric.range_text(F.col("reference_min"), F.col("reference_max")),
    })
