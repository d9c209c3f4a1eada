"""Where results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``; where that is unset, a local session takes a temporary folder and any other raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir() + '/assayflow-scratch').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a table in the shared scratch folder, read again: what follows plans from there, and losing an executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_line(df: DataFrame) -> Column:
    """A row as CSV text: nulls empty, booleans in lower case, text quoted where it must be."""

    def cell(name: str, kind: str):
        c = F.col(name)
        if kind == "string":
            quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
            c = F.when(c.rlike('[",\n\r]'), quoted).otherwise(c)
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.concat_ws(",", *(cell(n, k) for n, k in df.dtypes))


def canonical_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """``line``: rows as canonical CSV text in a fixed order, nulls first."""
    return df.orderBy(*(F.asc_nulls_first(c) for c in order)).select(csv_line(df).alias("line"))


def write_ordered_csv(df: DataFrame, path: str, order: list[str], files: int = 8) -> None:
    """Files that make one sorted CSV with its header when put together in the order of their names.

    Rows are dealt out by ranges of ``order`` and sorted within them, so no task has more than a range; a hash of the row divides what many rows share.
    """
    hashed = F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t))
    keys = [F.col(f"_k{i}").asc_nulls_first() for i in range(len(order))]
    picked = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    rows = df.select(F.lit(1).alias("_part"), *picked, hashed.alias("_h"), csv_line(df).alias("value"))
    kinds = dict(rows.dtypes)
    header = df.sparkSession.range(1).select(F.lit(0).alias("_part"), *(F.lit(None).cast(kinds[f"_k{i}"]).alias(f"_k{i}") for i in range(len(order))), F.lit(0).cast("long").alias("_h"), F.lit(",".join(df.columns)).alias("value"))
    by = [F.col("_part"), *keys, F.col("_h")]
    rows.union(header).repartitionByRange(files, *by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV with a header, ORC or JSON lines, partitioned on request."""
    writer = df.write.mode("overwrite").format(form)
    writer = writer.option("header", "true") if form == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)


class NothingSucceeded(ValueError):
    """A run none of whose inputs could be read."""


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], succeeded: str | None = None) -> dict[str, int]:
    """Write a table and return its counts, taken in the same pass; an error where ``succeeded`` counts nothing of what there was."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in counts.items())).write.mode("overwrite").parquet(path)
    found = seen.get
    if succeeded and found["rows"] and not found[succeeded]:
        raise NothingSucceeded(f"none of {found['rows']} succeeded: {found}")
    return found


def write_pages(pages: DataFrame, path: str) -> None:
    """Page payloads as JSON lines by document, with the results that they have now."""
    whole = pages.select("stem", F.to_json(F.col("payload").withField("lab_results", F.col("results"))).alias("value"))
    whole.write.mode("overwrite").partitionBy("stem").text(path)


def write_cache(cache: DataFrame, path: str) -> None:
    """A cache as JSON lines, by key."""
    cache.orderBy("key").write.mode("overwrite").json(path)


def decision_snapshot(rows: DataFrame) -> DataFrame:
    """Identity and decision of the rows that are decided."""
    return rows.filter(F.lower(F.trim("review_status")).isin("accepted", "rejected")).select("source_file", "page_number", "result_index", "review_status")
