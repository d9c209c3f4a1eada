import json

from pyspark.sql import functions as F

from assayflow.streaming import pages


def test_pages_are_published_once(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    for i, n in enumerate((1, 2, 1)):  # the third has the content of the first
        (src / f"{i}.json").write_text(json.dumps({"n": n}))
    stream = pages.distinct_content(pages.page_stream(spark, str(src)))
    pages.publish_batches(stream, lambda b: b.select(F.get_json_object("text", "$.n").alias("n")), str(out), str(check)).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == ["1", "2"]


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "t timestamp, k string, v double"
    batches = [[("2024-01-01 01:00:00", "a", 1.0), ("2024-01-03 01:00:00", "a", 2.0)], [("2024-01-01 02:00:00", "a", 9.0), ("2024-01-06 00:00:00", "a", 3.0)]]
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "t string, k string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
        q = pages.windowed_counts(spark.readStream.schema(schema).parquet(str(src)), "t", "k", "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r.start.date()): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == (1, 1.0) and got["2024-01-03"] == (1, 2.0)
