"""The export as tables that change where decisions do: documents, dates and labs that a decision touches, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayflow.functions import text as T
from assayflow.operators import refresh
from assayflow.plans import lab
from assayflow.sources.sinks import materialize

#: Parts of the normalized rows, by document.
BUCKETS = 64


def _bucket(c: str = "source_file") -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _day() -> Column:
    """A date as text, '-' for none, so that rows without a date meet."""
    return F.coalesce(F.col("date").cast("string"), F.lit("-"))


def _month(day: str = "day") -> Column:
    return F.when(F.col(day) == "-", F.lit("none")).otherwise(F.concat(F.lit("m"), F.left(day, F.lit(7))))  # a name that nothing takes for a date


class ExportStore:
    """Below ``root``: ``normalized``, the decided rows in primary form, by document; ``export``, the published rows, by month.

    What a document's rows are depends on that document. What the checks say of a row depends on the rows of its
    date, and on the observation of its lab before. So a decision changes the dates of those rows of its document that come out otherwise, and the
    next dates of their labs; these are checked again among the dates before them, and the months they lie in are written again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def export(self) -> DataFrame:
        return self._read("export").drop("month", "day")

    def _write(self, rows: DataFrame, name: str, part: str, touched: list | None = None) -> None:
        """All of a table, or some of its parts: these are replaced, and those without rows removed."""
        writer = rows.repartition(part).write.partitionBy(part)
        if touched is None:
            return writer.mode("overwrite").parquet(f"{self.root}/{name}")
        saved = materialize(rows, name)  # read before what it comes from is replaced
        saved.repartition(part).write.partitionBy(part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{name}")
        left = {r[0] for r in saved.select(part).distinct().collect()}
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        for value in touched:
            if value not in left:
                path = hadoop.Path(f"{self.root}/{name}/{part}={value}")
                path.getFileSystem(conf).delete(path, True)

    def build(self, rows: DataFrame, context: lab.Context, decisions: DataFrame | None = None) -> DataFrame:
        """Both tables anew."""
        normal = lab.normalized_rows(lab.decided_rows(rows, decisions), context, "export")
        self._write(normal.withColumn("bucket", _bucket()), "normalized", "bucket")
        found = lab.published(lab.checked_rows(self._read("normalized").drop("bucket"), context, "export"), context)
        self._write(found.withColumn("day", _day()).withColumn("month", _month()), "export", "month")
        return self.export()

    def refresh(self, rows: DataFrame, context: lab.Context, decisions: DataFrame, names: refresh.Mapper, units: refresh.Mapper, answers: str | None = None) -> tuple[DataFrame, lab.Context]:
        """The export and the caches after the mappers were asked what these lack: only documents with a key that is new are made again."""
        keyed = rows.withColumn("_row", F.struct(*lab.ORDER))
        new_names, new_units, grown = refresh.refresh(keyed, context.name_cache, context.unit_cache, context.specs, names, units, "_row", answers)
        if not grown:
            return self.export(), context
        after = lab.Context(context.specs, materialize(new_names, "names"), materialize(new_units, "units"))
        added = [new.join(old.select("key"), "key", "left_anti").select("key") for new, old in ((after.name_cache, context.name_cache), (after.unit_cache, context.unit_cache))]
        by_name = rows.withColumn("key", T.cache_key(F.col("raw_lab_name"), F.col("raw_section_name"))).join(added[0], "key", "left_semi").select("source_file")
        by_unit = refresh.unit_keys(rows, after.name_cache).join(added[1], "key", "left_semi").select("source_file")
        touched = materialize(by_name.union(by_unit).distinct(), "touched")
        return (self.export() if touched.isEmpty() else self.apply(rows, after, decisions, touched)), after

    def apply(self, rows: DataFrame, context: lab.Context, decisions: DataFrame, touched: DataFrame) -> DataFrame:
        """The export after ``decisions``, of which those on documents of ``touched(source_file)`` are new; ``rows`` may be these documents' alone."""
        touched = materialize(touched.select("source_file").distinct(), "touched")
        mine = rows.join(touched, "source_file", "left_semi")
        new = materialize(lab.normalized_rows(lab.decided_rows(mine, decisions), context, "export").withColumn("bucket", _bucket()), "new")
        buckets = [r.bucket for r in touched.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
        old = self._read("normalized").filter(F.col("bucket").isin(buckets))
        gone = old.join(touched, "source_file", "left_semi")
        columns = sorted(new.columns)
        marked = [rows.withColumn("_all", F.xxhash64(*columns)) for rows in (new, gone)]
        unlike = [a.join(b.select("_all"), "_all", "left_anti").select("lab_name", _day().alias("day")) for a, b in (marked, marked[::-1])]
        hit = materialize(unlike[0].union(unlike[1]).distinct(), "hit")  # labs and dates of the rows that are not as before
        self._write(old.join(touched, "source_file", "left_anti").unionByName(new), "normalized", "bucket", buckets)

        current = self._read("normalized").drop("bucket").withColumn("day", _day())
        seen = current.filter("date is not null and value is not null").select("lab_name", F.col("day").alias("other")).distinct()
        later = hit.join(seen, "lab_name").filter("day <> '-' and other > day").groupBy("lab_name", "day").agg(F.min("other").alias("day_"))
        days = materialize(hit.select("day").union(later.select("day_")).distinct(), "days")
        there = current.join(days, "day", "left_semi").select("lab_name", "day").distinct()
        before = there.join(seen, "lab_name").filter("other < day").groupBy("lab_name", "day").agg(F.max("other").alias("day_"))
        context_days = days.union(before.select("day_")).distinct()
        checked = lab.checked_rows(materialize(current.join(context_days, "day", "left_semi").drop("day"), "scope"), context, "export")
        again = lab.published(checked, context).withColumn("day", _day()).join(days, "day", "left_semi").withColumn("month", _month())
        months = [r.month for r in days.select(_month().alias("month")).distinct().collect()]
        kept = self._read("export").filter(F.col("month").isin(months)).join(days, "day", "left_anti")
        self._write(kept.unionByName(again), "export", "month", months)
        return self.export()
