"""Places in one order of a whole table, without one task that sees all of it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.sources.sinks import materialize

#: ``monotonically_increasing_id`` has the partition above these bits, and the row in it below.
_PART = 33


def global_positions(rows: DataFrame, order: list[Column | str], out: str = "position") -> DataFrame:
    """``out`` from zero, in ``order``, over all rows; of rows that are alike in it, each has a place of its own.

    Rows are dealt out by ranges and sorted within them, then written with their place in the range. One count for each range
    gives what lies before it: as many numbers as there are partitions. Ranges are also cut by a hash of the
    whole row, so one value that many rows share is no single range.
    """
    spark = rows.sparkSession
    hashed = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    keys = [*order, F.xxhash64(*hashed)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    saved = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "positions")
    counts = sorted((r.part, r.n) for r in saved.groupBy(F.shiftright("_at", _PART).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(part, n) for (part, _), n in zip(counts, before)], "_part long, _before long")
    placed = saved.withColumn("_part", F.shiftright("_at", _PART)).join(F.broadcast(offsets), "_part")
    return placed.withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1)) + F.col("_before")).select(*rows.columns, out)
