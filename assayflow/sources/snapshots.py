"""Snapshots of documents as CSV: audits, reuse and merging; approved cases for regression."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayflow.sources.sinks import write_ordered_csv

# ---- fixed values: columns without which a snapshot can't be reviewed; files of an approved case -----
REQUIRED = ("source_file", "page_number", "result_index")
CASE_FILES = ("case.json", "document.pdf", "expected.csv")
# ------------------------------------------------------------------------------------------------------


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


# A cell is quoted, with quotes inside doubled or after a backslash, or goes on up to a comma or the line's end.
_QUOTED = r'(?s:"(?:[^"\\]++|\\.|"")*+")(?=[,\r\n]|\z)'
_RECORD = rf"(?:{_QUOTED}|[^,\r\n]*+)(?:,(?:{_QUOTED}|[^,\r\n]*+))*+"
_CELL = rf"({_QUOTED}|[^,]*+),"


def _cells(record: Column) -> Column:
    def plain(cell: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(cell, r'(?s)^"(.*)"$', "$1"), r'""|\\"', '"')
        return F.when(cell == "", None).when(cell.startswith('"'), inner).otherwise(cell)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1)), plain)


def parse_snapshots(files: DataFrame) -> DataFrame:
    """``path, place, header, line, cells, malformed`` of CSV texts ``path, place, text``, each with a header of its own; a file of a header alone has one row without ``line``."""
    records = files.select("path", "place", F.filter(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0)), lambda r: r != "").alias("r")).filter(F.size("r") > 0)
    rows = records.select("path", "place", _cells(F.get("r", F.lit(0))).alias("header"), F.posexplode_outer(F.slice("r", 2, F.size("r"))).alias("line", "record"))
    cells = F.when(F.col("record").isNotNull(), _cells(F.col("record")))
    return rows.select("path", "place", "header", "line", cells.alias("cells")).withColumn("malformed", F.col("line").isNotNull() & (F.size("cells") != F.size("header")))


def snapshot_audit(parsed: DataFrame) -> DataFrame:
    """``path, n_rows, n_malformed, has_columns`` of each file of ``parse_snapshots``, in one scan."""
    whole = F.forall(F.array(*map(F.lit, REQUIRED)), lambda c: F.array_contains("header", c))
    return parsed.groupBy("path").agg(F.count("line").alias("n_rows"), F.count_if("malformed").alias("n_malformed"), F.bool_and(whole).alias("has_columns"))


def merged_rows(parsed: DataFrame) -> DataFrame:
    """The rows of all files by column names, null where a file has no such column. Columns come in the order of the files.

    One pass finds the names, of which there are as many as columns; the rows are read in another.
    """
    heads = parsed.select("place", F.posexplode("header").alias("pos", "name")).groupBy("name").agg(F.min(F.struct("place", "pos")).alias("at"))
    names = [r.name for r in heads.orderBy("at", "name").collect()]
    cell = lambda name: F.get("cells", (F.array_position("header", name) - 1).cast("int"))
    return parsed.filter("line is not null").select(*(F.when(F.array_contains("header", n), cell(n)).alias(n) for n in names))


def snapshot_texts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """``path, place, text`` of all files by one scan (None if there are none), and the paths that aren't there. A path may be a folder that Spark wrote."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for place, path in enumerate(first_seen(paths)):
        where = hadoop.Path(path)
        files = where.getFileSystem(conf)
        if files.exists(where):
            found.append((path, files.makeQualified(where).toString(), place))
        else:
            missing.append(path)
    if not found:
        return None, missing
    named = spark.createDataFrame(found, "path string, at string, place int")
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    texts = spark.read.text([at for _, at, _ in found], wholetext=True).select(F.explode(F.array(plain, F.regexp_replace(plain, "/[^/]*$", ""))).alias("at"), F.col("value").alias("text"))
    return texts.join(named, "at").select("path", "place", "text"), missing


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """A CSV snapshot for an audit, or None and what is wrong with it: not there, or empty. Malformed lines are counted."""
    texts, missing = snapshot_texts(spark, [path])
    if missing:
        return None, [f"snapshot not found: {path}"]
    parsed = parse_snapshots(texts)
    found = snapshot_audit(parsed).first()
    if found is None:
        return None, [f"snapshot is empty: {path}"]
    return merged_rows(parsed), [f"{found.n_malformed} malformed line(s): {path}"] if found.n_malformed else []


def reusable_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, has_columns``: whether each snapshot is there and has the columns that identify a row. One scan of all of them."""
    asked = spark.createDataFrame([(p,) for p in first_seen(paths)], "path string")
    texts, _ = snapshot_texts(spark, paths)
    if texts is None:
        return asked.withColumn("has_columns", F.lit(False))
    known = snapshot_audit(parse_snapshots(texts)).select("path", "has_columns")
    return asked.join(known, "path", "left").withColumn("has_columns", F.coalesce("has_columns", F.lit(False)))


def reusable_snapshot(spark: SparkSession, path: str) -> bool:
    return reusable_snapshots(spark, [path]).first().has_columns


def first_seen(items: list[str]) -> list[str]:
    """Each once, in the order in which they came."""
    return list(dict.fromkeys(items))


def merge_snapshots(spark: SparkSession, paths: list[str], skip_missing: bool = False) -> DataFrame | None:
    """Snapshots as one table by column names, missing columns null; None without any. A path that isn't there raises, or is left out."""
    texts, missing = snapshot_texts(spark, paths)
    if missing and not skip_missing:
        raise FileNotFoundError(f"snapshot not found: {missing[0]}")
    if texts is None:
        return None
    merged = merged_rows(parse_snapshots(texts))
    return merged if merged.columns else None


def split_documents(documents: DataFrame, snapshots: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to work on, and those whose snapshot (``stem, has_columns``) and pages (``stem, reusable``) can be used again."""
    known = documents.join(snapshots.select("stem", "has_columns"), "stem", "left").join(pages.select("stem", "reusable"), "stem", "left")
    whole = F.coalesce("has_columns", F.lit(False)) & F.coalesce("reusable", F.lit(False))
    marked = known.withColumn("_whole", whole).drop("has_columns", "reusable")
    return marked.filter("not _whole").drop("_whole"), marked.filter("_whole").drop("_whole")


def use_or_build(cached: DataFrame, built: DataFrame | None) -> DataFrame:
    """The cached documents' rows, with those built now after them where there were any to build."""
    return cached if built is None else cached.unionByName(built, allowMissingColumns=True)


def write_export(rows: DataFrame, path: str, order: list[str]) -> None:
    """The merged export: a table, and a sorted CSV in files that follow one another."""
    rows.write.mode("overwrite").parquet(f"{path}/all")
    write_ordered_csv(rows, f"{path}/all.csv", order)


def copy_text(spark: SparkSession, source: str, target: str) -> bool:
    """A small configuration file beside an output, by Spark's stores; False where there is none."""
    try:
        spark.read.text(source, wholetext=True).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(target)
    except AnalysisException as error:
        if _missing(error):
            return False
        raise
    return True


# ---- approved cases ----------------------------------------------------------------------------------
def approved_cases(spark: SparkSession, folder: str) -> DataFrame:
    """``case_id, stem, file_hash, original_filename, profile, missing``: the cases below a folder, each with the files that it lacks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    parts = F.split("path", "/")
    case = F.element_at(parts, -2).alias("case_id")
    names = files.load(folder).select(case, F.element_at(parts, -1).alias("name"), F.lit(None).cast("string").alias("text"))  # no file is opened for its name
    named = names.union(files.option("pathGlobFilter", "case.json").load(folder).select(case, F.element_at(parts, -1), F.col("content").cast("string")))
    meta = F.from_json(F.max("text"), "stem string, file_hash string, original_filename string, profile string").alias("m")
    cases = named.groupBy("case_id").agg(F.array_except(F.array(*map(F.lit, CASE_FILES)), F.collect_set("name")).alias("missing"), meta)
    return cases.select("case_id", "m.*", F.array_join("missing", ", ").alias("missing"))


def case_faults(cases: DataFrame) -> DataFrame:
    """``case_id, fault``: files or metadata that are missing, and stems that several cases have."""
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("stem", "file_hash", "original_filename")))
    lacking = cases.filter("missing <> ''").select("case_id", F.concat(F.lit("missing required files: "), "missing").alias("fault"))
    incomplete = cases.filter("missing = ''").filter(blank).select("case_id", F.lit("incomplete metadata").alias("fault"))
    several = cases.filter("trim(stem) <> ''").groupBy("stem").count().filter("count > 1").select("stem")
    twice = cases.join(several, "stem", "left_semi").select("case_id", F.concat(F.lit("stem repeats: "), "stem").alias("fault"))
    return lacking.union(incomplete).union(twice)


def stale_cases(existing: DataFrame, valid: DataFrame, key: str = "stem") -> DataFrame:
    """Cases whose document is no longer among the valid ones."""
    return existing.join(valid.select(key), key, "left_anti")


def merge_documents(frames: list[DataFrame]) -> DataFrame:
    """Documents' rows as one table by column names; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_cases(rows: DataFrame, cases: DataFrame, path: str) -> None:
    """``expected`` rows, ``case`` metadata and ``review_state`` of approved documents, each by case."""
    keyed = rows.join(cases.select("stem", "case_id"), "stem")
    keyed.write.mode("overwrite").partitionBy("case_id").option("header", "true").csv(f"{path}/expected")
    cases.write.mode("overwrite").partitionBy("case_id").json(f"{path}/case")
    decided = keyed.filter(F.lower(F.trim("review_status")).isin("accepted", "rejected"))
    decided.select("case_id", *REQUIRED, "review_status").write.mode("overwrite").partitionBy("case_id").json(f"{path}/review_state")
