"""Exact deduplication on a normalised text, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.llm.common import SPACES, Scratch, empty_if_null, keep_rows, row_key

#: One decimal orders rows by (most code points, smallest id): points * 2^65 + (2^63 - id); 0 stands for a null id.
_SHIFT, _TOP = str(2**65), str(2**63)


def _number(value: str) -> Column:
    return F.lit(value).cast("decimal(20,0)")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keys: bool = False) -> DataFrame:
    """Which rows have the same text, and which row of each class stays.

    Texts are equal when identical after deleting spaces and the controls tab to carriage return. The
    survivor has the most code points in its original text, then the smallest id. Returns per input row
    ``doc_id, keep_id, group_size, kept, text_sha256``, and with ``keys`` the ``row_key`` columns too.

    Plan: one aggregation keyed by (MD5, normalised text), which compares bytes inside each hash group and
    collapses copies before the shuffle, then a join of the narrow rows (no text) with one row per class.
    A hot class is thus one row per map task in the aggregation, and one side of a join whose other side
    AQE may split. If a hash holds two texts, its rows are told apart by their SHA-256 as well.

    Defined cases: a null text is empty, and all texts without characters are equal; a null id sorts
    last and stays null; of rows that repeat both id and text exactly one is kept; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    raw, key = empty_if_null(text), F.col(doc_id).cast("long")
    points = F.length(raw).cast("decimal(10,0)") * _number(_SHIFT)
    more = ["k1", "k2"] if keys else []
    rows = docs.select(
        *(row_key(text, doc_id) if keys else []),
        key.alias("doc_id"),
        F.regexp_replace(raw, SPACES + "+", "").alias("_norm"),
        (points + F.coalesce(_number(_TOP) - key.cast("decimal(20,0)"), _number("0"))).cast("decimal(38,0)").alias("_rank"),
    ).withColumn("_hash", F.unhex(F.md5("_norm")))
    classes = scratch.save(
        rows.groupBy("_hash", "_norm")
        .agg(F.max("_rank").alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", "_best", "group_size", F.sha2("_norm", 256).alias("text_sha256")),
        "classes",
    )
    narrow = rows.select(*more, "doc_id", "_rank", "_hash")
    on = ["_hash"]
    if not classes.groupBy("_hash").count().filter("count > 1").isEmpty():  # two texts with one hash
        narrow = rows.select(*more, "doc_id", "_rank", "_hash", F.sha2("_norm", 256).alias("text_sha256"))
        on = ["_hash", "text_sha256"]
    joined = scratch.save(narrow.withColumn("_row", F.monotonically_increasing_id()).join(classes, on), "rows")
    kept = F.col("_rank") == F.col("_best")
    if joined.filter(kept).count() > classes.count():  # some survivor has a row that repeats its id and text
        first = joined.filter(kept).groupBy("text_sha256").agg(F.min("_row").alias("_first"))
        joined = joined.join(first, "text_sha256")
        kept = F.col("_row") == F.col("_first")
    place = F.col("_best") % _number(_SHIFT)
    keep_id = F.when(place > 0, (_number(_TOP) - place).cast("long"))
    return joined.select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", *more)


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Defined cases: null, empty and blank texts are one class; null ids come last; of rows that repeat id and text
    one stays; an empty table gives none; columns of any name stay as they are.
    """
    return keep_rows(docs, exact_dedup(docs, text, doc_id, keys=True).filter("kept"), text, doc_id)
