"""Caches that grow: what they lack, mapped by a callable, and what of its answers is accepted."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from assayflow.functions import text as T
from assayflow.functions.text import UNKNOWN
from assayflow.operators.specs import Specs
from assayflow.operators.standardize import standardize_names
from assayflow.sources.sinks import materialize

Mapper = Callable[[list[tuple[str, str | None]]], Iterable[tuple[str, str | None, str]]]


def unit_column(df: DataFrame) -> str | None:
    return next((c for c in ("raw_unit", "raw_lab_unit") if c in df.columns), None)


def missing_names(rows: DataFrame, cache: DataFrame, order: str) -> DataFrame:
    """``key, raw_lab_name, raw_section_name``: contexts without an entry, in the spelling that comes first."""
    key = T.cache_key(F.col("raw_lab_name"), F.col("raw_section_name"))
    keyed = rows.filter("trim(coalesce(raw_lab_name, '')) <> ''").withColumn("key", key)
    first = Window.partitionBy("key").orderBy(order)
    return keyed.join(cache.select("key"), "key", "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("key", "raw_lab_name", "raw_section_name")


def unit_keys(rows: DataFrame, name_cache: DataFrame) -> DataFrame:
    """The rows whose lab is known by a name cache, with ``key``, ``raw_unit`` and ``lab_name`` of their entry in the unit cache."""
    unit = unit_column(rows)
    named = standardize_names(rows, name_cache).filter(F.col("lab_name_standardized") != UNKNOWN)
    raw = F.coalesce(F.col(unit), F.lit("")) if unit else F.lit("")
    return named.withColumns({"key": F.concat(T.unit_key(raw), F.lit("|"), F.lower("lab_name_standardized")), "raw_unit": raw, "lab_name": F.col("lab_name_standardized")})


def missing_units(rows: DataFrame, name_cache: DataFrame, unit_cache: DataFrame) -> DataFrame:
    """``key, raw_unit, lab_name``: pairs without an entry, of rows whose lab is known by the working name cache."""
    keyed = unit_keys(rows, name_cache).select("key", "raw_unit", "lab_name")
    return keyed.join(unit_cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("raw_unit").alias("raw_unit"), F.min("lab_name").alias("lab_name"))


def answered(misses: DataFrame, answers: DataFrame, vocabulary: DataFrame, value: str) -> DataFrame:
    """``key, value`` of answers to what was asked, within the vocabulary; one of each key."""
    known = answers.join(vocabulary.select(F.col(vocabulary.columns[0]).alias(value)).distinct(), value, "left_semi")
    return known.join(misses.select("key"), "key", "left_semi").groupBy("key").agg(F.min(value).alias(value))


#: Misses that the mapper is asked at a time.
BATCH = 200


def asked(misses: DataFrame, columns: list[str], mapper: Mapper, value: str, store: str | None = None) -> DataFrame:
    """``key, value``: the mapper's answers to ``misses(key, *columns)``, asked in batches by the tasks.

    With a ``store``, answers are kept in a table there, a task's as soon as the task is done: after a failure, and in later runs, what
    was answered isn't asked again. Nothing passes the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                rows = [tuple(None if pd.isna(x) else x for x in r) for r in part[columns].itertuples(index=False)]
                keys = dict(zip(rows, part["key"]))
                found = {tuple(a[:-1]): a[-1] for a in mapper(rows)}
                yield pd.DataFrame([(keys[q], a) for q, a in found.items() if q in keys], columns=["key", value])

    spark, kind = misses.sparkSession, f"key string, {value} string"
    if store is None:
        return materialize(misses.mapInPandas(run, kind), "answers")
    try:
        todo = misses.join(spark.read.schema(kind).parquet(store), "key", "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = misses
    parts = spark.sparkContext.defaultParallelism  # a number of their own, which adaptive execution leaves
    answers = materialize(todo, "asked").repartition(parts, "key").mapInPandas(run, kind)
    answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    return spark.read.schema(kind).parquet(store)


def refresh_names(rows: DataFrame, cache: DataFrame, specs: Specs, mapper: Mapper, order: str, store: str | None = None) -> DataFrame:
    """The cache with the mapper's accepted answers. Misses are distinct spellings, so the mapper sees few of many rows."""
    misses = materialize(missing_names(rows, cache, order), "misses")
    if misses.isEmpty():
        return cache
    answers = asked(misses, ["raw_lab_name", "raw_section_name"], mapper, "lab_name", store)
    return cache.select("key", "lab_name").unionByName(answered(misses, answers, specs.spec.select("lab_name"), "lab_name"))


def refresh_units(rows: DataFrame, name_cache: DataFrame, unit_cache: DataFrame, specs: Specs, mapper: Mapper, store: str | None = None) -> DataFrame:
    """The unit cache with the mapper's accepted answers. It is asked ``(raw unit, lab)`` and answers ``(raw unit, lab, unit)``."""
    misses = materialize(missing_units(rows, name_cache, unit_cache), "misses")
    if misses.isEmpty():
        return unit_cache
    answers = asked(misses, ["raw_unit", "lab_name"], mapper, "unit", store)
    return unit_cache.select("key", "unit").unionByName(answered(misses, answers, specs.units(), "unit"))


def refresh(rows: DataFrame, name_cache: DataFrame, unit_cache: DataFrame, specs: Specs, names: Mapper, units: Mapper, order: str, store: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Both caches, and whether either has grown: names first, then the units of labs that the new names know. Unknown entries are dropped and asked for again.

    ``store``: a folder for the answers, so that none is asked for twice.
    """
    name_cache, unit_cache = prune_unknown(name_cache, "lab_name"), prune_unknown(unit_cache, "unit", True)
    new_names = refresh_names(rows, name_cache, specs, names, order, store and f"{store}/names")
    new_units = refresh_units(rows, new_names, unit_cache, specs, units, store and f"{store}/units")
    grown = any(not new.join(old.select("key"), "key", "left_anti").isEmpty() for new, old in ((new_names, name_cache), (new_units, unit_cache)) if new is not old)
    return new_names, new_units, grown


def prune_unknown(cache: DataFrame, value: str, lab_keys: bool = False) -> DataFrame:
    """Without unknown values, and of unit entries without those that name no lab."""
    kept = cache.filter(F.col(value) != UNKNOWN)
    return kept.filter(F.col("key").contains("|") & ~F.col("key").endswith("|")) if lab_keys else kept
