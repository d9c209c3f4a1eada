"""Shared helpers of the training-data operators: shared scratch tables and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that separate words: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only, so that lengths and all other characters stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """``k1, k2``: two longs that rows share only if they repeat both id and text."""
    key = F.col(doc_id).cast("long")
    return [F.coalesce(key, F.lit(0)).cast("long").alias("k1"), F.xxhash64(empty_if_null(F.col(text).cast("string")), key.isNull()).alias("k2")]


def keep_rows(docs: DataFrame, kept: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``kept(k1, k2)``; of rows that share a key there, one."""
    one, two = (next(n for i in range(len(docs.columns) + 1) if (n := f"_key_{k}_{i}") not in docs.columns) for k in (1, 2))
    k1, k2 = row_key(text, doc_id)
    kept = kept.select(F.col("k1").alias(one), F.col("k2").alias(two))
    rows = docs.withColumns({one: k1, two: k2}).join(kept, [one, two], "left_semi")
    keys = docs.select(k1, k2)
    if not keys.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([one, two])
    return rows.select(*docs.columns)


class Scratch:
    """Tables in the shared folder named by ``spark.checkpoint.dir``.

    A saved table cuts the lineage: its files outlive the executor that wrote them and a task attempt
    commits its file whole or not at all. A temporary folder is used only where the setting is absent and Spark is local.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.gettempdir() + "/assayflow-scratch"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_PIECE = 4096


def sum_vectors(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of one vector per task, ``of`` its batches (None: nothing to add); None without any.

    Vectors travel in pieces, which are added in groups of 64 tasks and then over the groups, so no task
    reads more than a piece from each of many tasks. The driver gets one vector, whose size is the model's.
    """
    kind = "piece int, part int, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(batches)
        if total is not None:
            pieces = [total[i : i + _PIECE].astype(np.float64).tobytes() for i in range(0, len(total), _PIECE)]
            part = TaskContext.get().partitionId() // 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([part] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part", "numbers"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("numbers"))
        return pa.table({"piece": table.column("piece")[:1], "part": table.column("part")[:1], "numbers": pa.array([total.tobytes()], pa.binary())})

    summed = rows.mapInArrow(run, kind).groupBy("piece", "part").applyInArrow(add, kind).groupBy("piece").applyInArrow(add, kind)
    pieces = sorted(summed.collect(), key=lambda r: r.piece)
    return np.concatenate([np.frombuffer(r.numbers, np.float64) for r in pieces]) if pieces else None
