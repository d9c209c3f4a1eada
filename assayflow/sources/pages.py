"""Page documents: discovery, reading, repair, and flattening to review rows."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayflow.functions import dates, numeric, text as X
from assayflow.sources import repair
from assayflow.sources.sinks import materialize, write_counted
from assayflow.sources.repair import BOUND_FIELDS, BOX_FIELDS, RESULT, TEXT_FIELDS, whole_box

# ---- fixed values: the name of the row that stands for a failed page -------------------------------
FAILED_NAME = "[EXTRACTION FAILED]"
# ----------------------------------------------------------------------------------------------------
MARKER = T.ArrayType(T.StructType([T.StructField("anchor_result_index", T.IntegerType()), T.StructField("created_at", T.StringType())]))
#: Results stay raw JSON at first: one bad element must not void the array.
PAGE = T.StructType([
    T.StructField("collection_date", T.StringType()), T.StructField("report_date", T.StringType()), T.StructField("lab_facility", T.StringType()),
    T.StructField("page_has_lab_data", T.BooleanType()), T.StructField("source_file", T.StringType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("_extraction_failed", T.BooleanType()), T.StructField("_failure_reason", T.StringType()), T.StructField("_retry_count", T.IntegerType()),
    T.StructField("lab_results", T.ArrayType(T.StringType())), T.StructField("review_missing_rows", MARKER),
])


# ---- discovery -------------------------------------------------------------------------------------
def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, name, content_hash, document, is_copy``: files of a folder itself whose lower-case name fits, copies after their original."""
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower()) + "$"
    files = spark.read.format("binaryFile").load(f"{folder}/*").select("path", "content")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.lower("name").rlike(regex))
    hashed = named.select("path", "name", F.sha2("content", 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("original"))
    out = hashed.join(first, "content_hash").withColumn("is_copy", F.col("path") != F.col("original"))
    return out.withColumn("document", F.concat_ws("_", X.document_label(F.col("name")), F.substring("content_hash", 1, 8)))


LEDGER = "path string, length long, modified timestamp, content_hash string, document string"


def new_contents(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Of ``found(path, content_hash)`` the contents that no run has seen, each under its first path."""
    fresh = found.join(ledger.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min("path").alias("path"))


def discover_new(spark: SparkSession, folder: str, ledger: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, document, content_hash`` of contents that runs before haven't seen; the ledger, a table at that path, remembers what was read.

    Files are listed without being opened. Those whose path, size and time the ledger has are left alone; only the others are read and hashed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(f"{folder}/*")
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower()) + "$"
    listed = files.select("path", "length", F.col("modificationTime").alias("modified")).filter(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(regex))
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], LEDGER)
    paths = [r.path for r in listed.join(known, ["path", "length", "modified"], "left_anti").select("path").toLocalIterator()]  # as a listing is: names only
    if not paths:
        return spark.createDataFrame([], "path string, document string, content_hash string")
    read = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"))
    label = F.concat_ws("_", X.document_label(F.element_at(F.split("path", "/"), -1)), F.substring("content_hash", 1, 8))
    read = materialize(read.withColumn("document", label), "discovered")
    fresh = materialize(new_contents(read, known).join(read.select("path", "document"), "path").select("path", "document", "content_hash"), "fresh")
    read.write.mode("append").parquet(ledger)
    return fresh


def read_documents(spark: SparkSession, root: str, stems: list[str], out: str) -> dict[str, int]:
    """The rows of the documents of a list, written to ``out``, and what became of their pages: ``rows``, ``read`` and ``failed``, counted as they are written.

    Raises where no page of the list could be read. A name that repeats counts once; one without pages has none.
    """
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(stems)], "stem string")
    pages = with_results(read_pages(spark, root).join(wanted, "stem", "left_semi"))
    failed = F.coalesce("payload._extraction_failed", F.lit(False))
    return write_counted(pages.withColumn("failed", failed), out, {"read": ~F.col("failed"), "failed": F.col("failed")}, "read")


def document_of(path: Column) -> Column:
    """struct<directory, stem, hash8, page> of a page's path: ``{stem}_{hash8}/{stem}.NNN.json``; nulls where it doesn't fit."""
    directory = F.try_element_at(F.split(path, "/"), F.lit(-2))
    part = lambda i: F.nullif(F.regexp_extract(directory, r"^(.+)_([0-9a-fA-F]{8})$", i), F.lit(""))
    return F.struct(directory.alias("directory"), part(1).alias("stem"), part(2).alias("hash8"), F.regexp_extract(path, r"\.(\d{3})\.json$", 1).try_cast("int").alias("page"))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Page documents below ``root``: ``path, stem, page, payload, text``. Files that aren't JSON objects are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the path comes as a URI
    rows = files.select(plain.alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("_d", document_of(F.col("path"))).filter("_d.stem is not null and _d.page is not null")
    parsed = rows.withColumn("payload", F.when(F.trim("text").startswith("{"), F.from_json("text", PAGE)))
    return parsed.filter("payload is not null and try_parse_json(text) is not null").select("path", F.col("_d.stem").alias("stem"), F.col("_d.page").alias("page"), "payload", "text")


# ---- results ---------------------------------------------------------------------------------------
def with_results(pages: DataFrame) -> DataFrame:
    """``results``: the rows of each page, whatever shape they came in; see ``repair.with_rows``."""
    raw = F.col("payload.lab_results")
    odd = rf'"lab_results"|"({"|".join(BOX_FIELDS + BOUND_FIELDS)})"\s*:\s*"|"({"|".join(TEXT_FIELDS)})"\s*:\s*[^"n\s]'  # numbers as text, or text as numbers
    plain = F.coalesce(F.forall(raw, lambda x: F.trim(x).startswith("{") & ~x.rlike(odd)), F.lit(False))
    read = F.transform(F.transform(raw, lambda x: F.from_json(x, RESULT)), whole_box)
    return repair.with_rows(pages, "text", plain, read)


# ---- review rows -----------------------------------------------------------------------------------
def flatten(pages: DataFrame, statuses: list[str] | None = None, forward_only: bool = False) -> DataFrame:
    """Review rows of pages with ``results``. Indices count what the status filter drops.

    The first usable date of a document is that of all its rows, or with ``forward_only`` of those from its page on;
    a date in the file's name stands in for it.
    """
    window = Window.partitionBy("stem").orderBy("page").rowsBetween(Window.unboundedPreceding, 0 if forward_only else Window.unboundedFollowing)
    own = dates.iso_date(dates.page_date(F.col("payload.collection_date"), F.col("payload.report_date")))
    named = F.coalesce(F.first(own, ignorenulls=True).over(window), dates.name_date(F.col("stem")))
    rows = pages.withColumn("date", named).select(
        "date", F.coalesce("payload.source_file", F.concat("stem", F.lit(".pdf"))).alias("source_file"), F.coalesce("payload.page_number", "page").alias("page_number"),
        F.coalesce("payload._extraction_failed", F.lit(False)).alias("page_failed"), F.posexplode("results").alias("result_index", "r"),
    )
    rows = rows.filter("r is not null").select("date", "source_file", "page_number", "result_index", "page_failed", "r.*")
    reason = X.append_reason(F.col("review_reason"), F.col("page_failed"), "EXTRACTION_FAILED")
    rows = rows.withColumns({"review_reason": reason, "review_needed": F.coalesce("review_needed", F.lit(False)) | F.col("page_failed")}).drop("page_failed")
    return rows if statuses is None else rows.filter(X.persisted_status(F.col("review_status")).isin(*statuses))


def missing_markers(pages: DataFrame) -> DataFrame:
    """``source_file, page_number, anchor_result_index, created_at`` of rows that reviewers found missing."""
    return pages.select(F.coalesce("payload.source_file", F.concat("stem", F.lit(".pdf"))).alias("source_file"), F.coalesce("payload.page_number", "page").alias("page_number"), F.inline("payload.review_missing_rows")).filter("anchor_result_index is not null")


def failed_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("payload._extraction_failed").select(F.format_string("%s page %d", "stem", "page").alias("page"), F.coalesce("payload._failure_reason", F.lit("unknown")).alias("reason"))


def malformed_boxes(results: Column) -> Column:
    """Column-like boxes on a page: one alone, three or more, or two side by side."""
    boxes = F.filter(results, lambda r: numeric.column_like_box(*(r[c] for c in BOX_FIELDS)))
    lefts = F.array_sort(F.transform(boxes, lambda r: r["bbox_left"]))
    near = F.exists(F.zip_with(F.slice(lefts, 2, F.greatest(F.size(lefts) - 1, F.lit(0))), lefts, lambda b, a: b - a), lambda gap: gap <= 30)
    return (F.size(boxes) == 1) | (F.size(boxes) >= 3) | ((F.size(boxes) == 2) & F.coalesce(near, F.lit(False)))


def reusable(pages: DataFrame) -> DataFrame:
    """``stem, reusable``: documents all of whose pages were read and have whole, row-like boxes."""
    whole = F.forall("results", lambda r: r["bbox_left"].isNotNull())
    good = ~F.coalesce("payload._extraction_failed", F.lit(False)) & F.coalesce(whole, F.lit(False)) & ~F.coalesce(malformed_boxes(F.col("results")), F.lit(False))
    return pages.groupBy("stem").agg(F.bool_and(good).alias("reusable"))


def needs_fallback(pages: DataFrame) -> Column:
    """Pages to be read again by other means: failed, or without results where lab data may be."""
    return F.coalesce("payload._extraction_failed", F.lit(False)) | ((F.size("results") == 0) & F.coalesce("payload.page_has_lab_data", F.lit(True)))


def malformed(results: Column) -> Column:
    """Why a page is to be read again at once: a row without a whole box, or boxes that are columns; null if neither."""
    broken = F.exists(results, lambda r: r["bbox_left"].isNull() | r["bbox_top"].isNull() | r["bbox_right"].isNull() | r["bbox_bottom"].isNull())
    return F.when(F.coalesce(broken, F.lit(False)), "incomplete boxes").when(F.coalesce(malformed_boxes(results), F.lit(False)), "column-like boxes")


def salvage(results: Column) -> Column:
    """The rows whose name is one: there, and no text of several fields run together."""
    return F.filter(results, lambda r: r["raw_lab_name"].isNotNull() & (F.trim(r["raw_lab_name"]) != "") & ~X.has_field_label(r["raw_lab_name"]))


def with_placeholder(pages: DataFrame) -> DataFrame:
    """A failed page without results gets one row that names the failure, so that a reviewer sees it."""
    reason = F.coalesce("payload._failure_reason", F.lit("Unknown extraction failure"))
    given = {"raw_lab_name": F.lit(FAILED_NAME), "raw_comments": reason}
    row = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT.fields))
    empty = F.coalesce("payload._extraction_failed", F.lit(False)) & (F.coalesce(F.size("results"), F.lit(0)) <= 0)
    return pages.withColumn("results", F.when(empty, F.array(row)).otherwise(F.col("results")))


def resolve_directories(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """``stem, directory``: the first folder of each document's stem, null without one. ``paths(path)`` are pages' paths."""
    found = paths.select(document_of(F.col("path")).alias("d")).filter("d.stem is not null").groupBy(F.col("d.stem").alias("stem")).agg(F.min("d.directory").alias("directory"))
    return documents.select("stem").distinct().join(found, "stem", "left")


def legacy_moves(folders: DataFrame, sources: DataFrame) -> DataFrame:
    """``folder, target, status``: what becomes of each folder that was named before names held a hash.

    ``folders(folder)`` are the names there are, ``sources(name, content_hash)`` the files to match by stem.
    Status is ``already_migrated`` for a name that ends in a hash; ``source_not_found`` where no file, or more
    than one, has the folder's name for its stem; ``target_exists`` where another folder has the new name;
    else ``renamed``. Files of one stem are counted before they meet the folders, so a hot stem is one row.
    A repeated folder name is one row; null names are left out; without sources no folder moves.
    """
    named = folders.select("folder").filter("folder is not null").distinct()
    hashed = F.col("folder").rlike("_[0-9a-f]{8}$")
    stems = sources.groupBy(X.document_label(F.col("name")).alias("_stem")).agg(F.count(F.lit(1)).alias("_n"), F.min("content_hash").alias("_hash"))
    met = named.join(stems, (F.col("folder") == F.col("_stem")) & ~hashed, "left")
    wanted = met.withColumn("target", F.when(F.col("_n") == 1, F.concat_ws("_", "folder", F.substring("_hash", 1, 8))))
    there = named.select(F.col("folder").alias("_there"))
    status = F.when(hashed, "already_migrated").when(F.col("target").isNull(), "source_not_found").when(F.col("_there").isNotNull(), "target_exists").otherwise("renamed")
    return wanted.join(there, F.col("target") == F.col("_there"), "left").select("folder", "target", status.alias("status"))


def with_targets(rows: DataFrame, directories: DataFrame) -> DataFrame:
    """``target``: the page file that a review row is kept in; null where its document has no folder."""
    stem = X.document_label(F.col("source_file"))
    joined = rows.withColumn("_stem", stem).join(directories.select(F.col("stem").alias("_s"), "directory"), F.col("_stem") == F.col("_s"), "left")
    return joined.withColumn("target", X.page_path(F.col("directory"), F.col("_stem"), F.col("page_number"))).drop("_stem", "_s", "directory")


def backfill_statuses(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the status that their page has for them now, by document, page and index."""
    kept = flatten(pages).select("source_file", "page_number", "result_index", X.persisted_status(F.col("review_status")).alias("review_status"))
    return rows.drop("review_status").join(kept, ["source_file", "page_number", "result_index"], "left")


def artifact_payload(rows: DataFrame, width: int = 1700, height: int = 2200) -> DataFrame:
    """``row_id, payload``: what a reviewer outside is sent for a row, as JSON: its identity, boxes and content."""
    box = numeric.scale_box([F.col(c) for c in BOX_FIELDS], F.lit(width), F.lit(height))
    whole = F.when(F.col("bbox_left").isNotNull(), F.struct(*(F.col(c).alias(c.removeprefix("bbox_")) for c in BOX_FIELDS)))
    content = F.struct(*(F.col(c) for c in rows.columns if c in RESULT.fieldNames() and c not in BOX_FIELDS))
    identity = [F.col(c) for c in ("source_file", "page_number", "result_index")]
    payload = F.to_json(F.struct(*identity, whole.alias("bbox"), box.alias("pixel_bbox"), content.alias("row")))
    return rows.select(X.row_id(*identity).alias("row_id"), payload.alias("payload"))


def rename_fields(results: Column, renames: dict[str, str], dropped: tuple[str, ...] = ()) -> Column:
    """Result rows with fields renamed where the new name is free, and fields dropped."""

    def change(r: Column) -> Column:
        for old, new in renames.items():
            r = r.withField(new, r[old]).dropFields(old)
        return r.dropFields(*dropped) if dropped else r

    return F.transform(results, change)


def load_cache(spark: SparkSession, path: str, value: str = "lab_name") -> DataFrame:
    """``key, value`` of a JSON map. Unknown values are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", value))
    return rows.filter(F.col(value) != X.UNKNOWN)
