"""Reports on what is unknown, failed or doubtful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.functions import text as T
from assayflow.functions.text import UNKNOWN
from assayflow.operators.specs import Specs


def unknown_counts(rows: DataFrame) -> DataFrame:
    """``raw_lab_name, raw_lab_unit, lab_type, n``, most frequent first, of rows with an unknown lab or unit."""
    unknown = (F.col("lab_name_standardized") == UNKNOWN) | (F.col("lab_unit_standardized") == UNKNOWN)
    return rows.filter(unknown & F.col("raw_lab_name").isNotNull()).groupBy("raw_lab_name", "raw_lab_unit", "lab_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "raw_lab_name")


def unknown_shares(rows: DataFrame) -> DataFrame:
    lab, unit = F.col("lab_name_standardized") == UNKNOWN, F.col("lab_unit_standardized") == UNKNOWN
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.agg(share(lab).alias("unknown_labs"), share(unit).alias("unknown_units"), F.count_distinct(F.when(lab, F.col("raw_lab_name"))).alias("distinct_labs"), F.count_distinct(F.when(unit, F.col("raw_lab_unit"))).alias("distinct_units"))


def categorize(rows: DataFrame, column: str, rules: list[tuple[str, str]], other: str = "other", by: tuple[str, ...] = ()) -> DataFrame:
    """``category, n`` by the first rule (category, pattern) that a text fits, within the columns of ``by``."""
    kind: Column = F.lit(other)
    for category, pattern in reversed(rules):
        kind = F.when(F.lower(column).rlike(pattern), category).otherwise(kind)
    return rows.groupBy(kind.alias("category"), *by).agg(F.count(F.lit(1)).alias("n"))


def with_flags(rows: DataFrame, flagged: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """One boolean column for each code: whether ``flagged(keys, code)`` has the row. A row flagged often is one row of the join."""
    named = flagged.groupBy(*keys).agg(F.collect_set("code").alias("_codes"))
    return rows.join(named, keys, "left").withColumns({c: F.coalesce(F.array_contains("_codes", c), F.lit(False)) for c in codes}).drop("_codes")


def corpus_rollup(rows: DataFrame, reason: str = "review_reason") -> DataFrame:
    """``kind, name, source_file, n, whole``: rows by status and by reason, in each document and (``whole``) in all, and how many there are.

    One scan: a row is taken apart into what it counts for, and counted by grouping sets.
    """
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    own = F.array(pair("rows", F.lit("all")), pair("status", T.status_label(F.col("review_status"))))
    reasons = F.coalesce(F.transform(T.reason_codes(F.col(reason)), lambda code: pair("reason", code)), F.array().cast("array<struct<kind:string,name:string>>"))
    parts = rows.select("source_file", F.inline(F.concat(own, reasons)))
    sets = parts.groupingSets([["kind", "name"], ["kind", "name", "source_file"]], "kind", "name", "source_file")
    return sets.agg(F.count(F.lit(1)).alias("n"), (F.grouping("source_file") == 1).alias("whole")).select("kind", "name", "source_file", "n", "whole")


def corpus_counts(rows: DataFrame, reason: str = "review_reason") -> DataFrame:
    """``kind, name, n``: rows by document, status and reason, what a report of the corpus lists."""
    counts = corpus_rollup(rows, reason)
    document = (F.col("kind") == "rows") & ~F.col("whole")
    kept = counts.filter(document | ((F.col("kind") != "rows") & F.col("whole")))
    return kept.select(F.when(document, "document").otherwise(F.col("kind")).alias("kind"), F.when(document, F.col("source_file")).otherwise(F.col("name")).alias("name"), "n")


def units_without_conversion(rows: DataFrame, specs: Specs) -> DataFrame:
    """``lab_name, unit, n``: units of known labs that their specification doesn't convert."""
    pairs = rows.filter(F.col("lab_name_standardized") != UNKNOWN).groupBy(F.col("lab_name_standardized").alias("lab_name"), F.col("lab_unit_standardized").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.filter("unit is not null").join(specs.factors(), ["lab_name", "unit"], "left_anti")


def codes_of_several_labs(specs: Specs) -> DataFrame:
    """``loinc_code, labs`` of codes that more than one lab has."""
    return specs.spec.filter("trim(coalesce(loinc_code, '')) <> ''").groupBy("loinc_code").agg(F.array_sort(F.collect_set("lab_name")).alias("labs")).filter(F.size("labs") > 1)


def null_value_pages(pages: DataFrame, most: float = 0.5) -> DataFrame:
    """Pages most of whose results have no value."""
    share = F.aggregate("results", F.lit(0.0), lambda n, r: n + F.when(r["raw_value"].isNull(), 1.0).otherwise(0.0)) / F.size("results")
    return pages.filter((F.size("results") > 0) & (share > most)).select("stem", "page", share.alias("null_share"))


def top(counts: DataFrame, by: str = "n", limit: int = 10) -> DataFrame:
    return counts.orderBy(F.desc(by), *[c for c in counts.columns if c != by]).limit(limit)
