"""Streams of pages and observations. The batch functions do the work; this adds what an unbounded input needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """New page files below a folder, as ``path, text``."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).option("wholetext", "true").text(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))


def distinct_content(stream: DataFrame, content: str = "text", time: str = "seen_at", within: str = "1 day") -> DataFrame:
    """Each content once within the watermark."""
    return stream.withWatermark(time, within).withColumn("content_hash", F.sha2(content, 256)).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by key and tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def publish_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch through a batch function, appended under its batch number: a batch that is run again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
