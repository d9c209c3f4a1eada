import os

import pytest
from pyspark.sql import functions as F
from test_snapshots import CONFIG, ROWS

from assayflow.operators import review
from assayflow.operators.specs import Specs
from assayflow.plans import lab, rebuild

LIMITS = CONFIG | {"Blood - Glucose": CONFIG["Blood - Glucose"] | dict(max_daily_change=20)}


@pytest.fixture(scope="module")
def run(spark):
    days = ["2024-01-01", "2024-01-09", "2024-02-03", "2024-03-05", "2024-03-06", None]
    rows = [(f"{d}.pdf", 1, i, days[(i + k) % 6], "Glicose", None, str(80 + 7 * i + 200 * (i == 3)), "mg/dL", None, None, None, None, False, None, "accepted" if (i + k) % 3 else None) for k, d in enumerate("abcd") for i in range(6)]
    names = spark.createDataFrame([("glicose", "Blood - Glucose")], "key string, lab_name string")
    units = spark.createDataFrame([("mg/dl|blood - glucose", "mg/dL")], "key string, unit string")
    return spark.createDataFrame(rows, ROWS), lab.Context(Specs.from_dict(spark, LIMITS), names, units)


def files(root):
    found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.startswith("part-")]
    return {f: os.stat(f).st_mtime_ns for f in found}


def shown(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*review.EXPORT).collect())


def test_decisions_change_what_they_touch(spark, run, tmp_path):
    rows, context = run
    store = rebuild.ExportStore(spark, str(tmp_path))
    standing = rows.filter("review_status is not null").select(*lab.ORDER, F.col("review_status").alias("status"), F.lit("0").alias("decided_at"))
    assert shown(store.build(rows, context, standing)) == shown(lab.final_export(rows, context, standing))
    before = files(tmp_path)
    log = standing
    for step, (doc, i, status) in enumerate([("a.pdf", 0, "accepted"), ("b.pdf", 1, "rejected")]):
        new = spark.createDataFrame([(doc, 1, i, status, str(step + 1))], "source_file string, page_number int, result_index int, status string, decided_at string")
        log = log.unionByName(new)
        got = store.apply(rows.filter(F.col("source_file") == doc), context, log, new)
        assert shown(got) == shown(lab.final_export(rows, context, log)), step
        if step == 0:  # one row of 1 January: its month and the next day of its lab, no others
            after = files(tmp_path)
            same = {f for f in before if after.get(f) == before[f]}
            assert {f.split("month=")[1][:8] for f in same if "/export/" in f} == {"m2024-02", "m2024-03", "none/par"}
            assert sum("/normalized/" in f for f in same) == sum("/normalized/" in f for f in before) - 1


def test_a_month_that_loses_its_last_row_goes(spark, run, tmp_path):
    rows, context = run
    rows = rows.filter("source_file = 'a.pdf' and (result_index = 1 or result_index = 2)")
    store = rebuild.ExportStore(spark, str(tmp_path))
    log = rows.select(*lab.ORDER, F.lit("accepted").alias("status"), F.lit("0").alias("decided_at"))
    assert len(shown(store.build(rows, context, log))) == 2
    log = log.unionByName(spark.createDataFrame([("a.pdf", 1, 2, "rejected", "1")], "source_file string, page_number int, result_index int, status string, decided_at string"))
    assert len(shown(store.apply(rows, context, log, log))) == 1 and not os.path.exists(tmp_path / "export" / "month=m2024-02")


def test_new_names_touch_only_their_documents(spark, run, tmp_path):
    rows, context = run
    rows = rows.filter("source_file in ('a.pdf', 'b.pdf') and result_index < 3").withColumn("raw_lab_name", F.when(F.col("source_file") == "b.pdf", "Novo").otherwise(F.col("raw_lab_name")))
    log = rows.select(*lab.ORDER, F.lit("accepted").alias("status"), F.lit("0").alias("decided_at"))
    store = rebuild.ExportStore(spark, str(tmp_path / "store"))
    store.build(rows, context, log)
    before = files(tmp_path / "store" / "normalized")
    names = lambda asked: [(n, s, "Blood - Cells") for n, s in asked]
    units = lambda asked: [(u, n, "10^9/L") for u, n in asked]
    got, after = store.refresh(rows, context, log, names, units, str(tmp_path / "answers"))
    assert shown(got) == shown(lab.final_export(rows, after, log)) and {r.lab_name for r in got.collect()} == {"Blood - Glucose", "Blood - Cells"}
    now = files(tmp_path / "store" / "normalized")
    assert sum(now.get(f) == t for f, t in before.items()) == len(before) >= 1  # b.pdf had no rows before
    nothing = lambda asked: []
    assert store.refresh(rows, after, log, nothing, nothing)[1] is after
