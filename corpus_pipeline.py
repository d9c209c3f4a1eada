"""From raw documents to packed batches: quality, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm.common import Scratch, table
from assayflow.llm.exact_dedup import drop_exact_copies
from assayflow.llm.latent import drop_leaks
from assayflow.llm.packing import pack
from assayflow.llm.quality import drop_rejected, fit_quality
from assayflow.llm.simhash import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects, as poor or as toxic, go.

    Null and empty texts are judged as empty ones, a null language or source as a value of its own; rows that
    repeat stay or go together; without labels, or without documents, all stay. Columns of any name stay as they are.
    """
    return drop_rejected(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one document stays: the longest, then the least id.

    Null, empty and blank texts are copies of one another; null ids come last; of rows that repeat, one stays;
    an empty table gives none. Columns of any name stay as they are.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word similarities of 0.8 or more, the document of the least id stays.

    Texts without words, null ones included, are one group; null ids come last; of rows that repeat, one stays;
    an empty table gives none. Columns of any name stay as they are.
    """
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing, items without words are held by none; null ids and rows that repeat are
    judged by their texts; an empty table gives none. Columns of any name stay as they are.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as batches of a token budget in length buckets.

    Null and empty texts have no tokens and lie in the shortest bucket; null ids and rows that repeat are rows
    like others; a text beyond the budget is a batch of its own; an empty table gives none.
    """
    return pack(docs)


#: Each takes what its predecessor kept; all but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packing),
]

#: The classifier is trained and the groups of near copies are transitive: SQL can't express either.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
