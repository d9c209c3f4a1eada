"""Which of several rows stays, and what repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; null keys are equal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def prefer_primary(df: DataFrame, order: list[str], date: str = "date", lab: str = "lab_name", unit: str = "lab_unit_standardized", primary: str = "primary_unit") -> DataFrame:
    """One row for each date and lab: the first whose standard unit, before conversion, is the primary one, or else the first."""
    return first_of(df, [date, lab], [F.when(F.col(unit) == F.col(primary), 0).otherwise(1), *order])


def latest_only(df: DataFrame, order: list[str], date: str = "date", lab: str = "lab_name") -> DataFrame:
    return first_of(df, [lab], [F.col(date).desc_nulls_last(), *order])


def content_copies(df: DataFrame, content: str, order: str) -> DataFrame:
    """``content_hash, original, is_copy`` for each value of ``order``: the least one of a content is the original.

    Only hashes are shuffled; a content that many rows share is a partial minimum in each task, and then joined.
    """
    hashed = df.select(order, F.sha2(F.col(content), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("original"))
    return hashed.join(first, "content_hash").withColumn("is_copy", F.col(order) != F.col("original"))


def repeated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows whose every column, as text, is that of another row; missing values print alike."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))
    hashed = df.withColumn("_hash", F.sha2(text, 256))
    return hashed.join(hashed.groupBy("_hash").count().filter("count > 1").select("_hash"), "_hash", "left_semi").drop("_hash")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that several rows have; null keys are equal. A hot key is a partial count in each task, then one row of a join."""
    keyed = df.withColumn("_key", F.struct(*keys))
    several = df.groupBy(F.struct(*keys).alias("_several")).count().filter("count > 1").select("_several")
    return keyed.join(several, F.col("_key").eqNullSafe(F.col("_several")), "left_semi").drop("_key")
