import json
import uuid

import pytest
from pyspark.sql import functions as F

from assayflow.operators import refresh, review
from assayflow.operators.specs import Specs
from assayflow.plans import lab
from assayflow.sources import pages, sinks, snapshots

CONFIG = {
    "Blood - Glucose": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="1-1", alternatives=[{"unit": "g/L", "factor": 100.0}]),
    "Blood - Cells": dict(lab_type="blood", primary_unit="10^9/L", loinc_code="1-2", ranges={"default": [2, 8]}),
    "Blood - Cells (%)": dict(lab_type="blood", primary_unit="%", loinc_code="1-3", ranges={"default": [20, 70]}),
}
ROWS = "source_file string, page_number int, result_index int, date string, raw_lab_name string, raw_section_name string, raw_value string, raw_lab_unit string, raw_reference_range string, raw_comments string, raw_reference_min double, raw_reference_max double, review_needed boolean, review_reason string, review_status string"


@pytest.fixture(scope="module")
def run(spark):
    make = lambda page, i, name, value, unit, low=None, high=None: ("a.pdf", page, i, "2024-01-0%d" % (page + i), name, None, value, unit, None, None, low, high, False, None, None)
    rows = spark.createDataFrame([make(1, 0, "Glicose", "92", "mg/dL"), make(1, 1, "Células", "30", None, 20.0, 70.0), make(2, 0, "Novo", "0.9", "g/L")], ROWS)
    names = spark.createDataFrame([("glicose", "Blood - Glucose"), ("células", "Blood - Cells")], "key string, lab_name string")
    units = spark.createDataFrame([("mg/dl|blood - glucose", "mg/dL")], "key string, unit string")
    return rows, lab.Context(Specs.from_dict(spark, CONFIG), names, units)


def test_a_blank_unit_follows_the_printed_range(run):
    rows, context = run
    got = {r.raw_lab_name: (r.lab_name, r.lab_unit) for r in lab.review_ledger(rows, context).collect()}
    assert got["Células"] == ("Blood - Cells (%)", "%") and got["Glicose"] == ("Blood - Glucose", "mg/dL")


def test_requests_by_opaque_id(spark, run):
    rows, context = run
    from assayflow.functions import text as T

    ids = {r.raw_lab_name: r.id for r in rows.select("raw_lab_name", T.row_id(F.col("source_file"), F.col("page_number"), F.col("result_index")).alias("id")).collect()}
    far = spark.range(1).select(T.row_id(F.lit("a.pdf"), F.lit(1), F.lit(9)).alias("id")).first().id
    asked = spark.createDataFrame([(ids["Glicose"], "Accept"), (ids["Células"], "missing_row"), (far, "accept"), (ids["Novo"], "praise")], "row_id string, action string")
    log, markers = spark.createDataFrame([], review.DECISION), spark.createDataFrame([], review.MISSING)
    log, markers, refused, export = lab.apply_requests(rows, context, log, markers, asked, F.lit("2024-05-01T00:00:00+00:00"))
    assert [(r.result_index, r.status) for r in log.collect()] == [(0, "accepted")] and markers.first().anchor_result_index == 1
    assert {r.refused for r in refused.collect()} == {"out of range", "unknown action"}
    assert [r.lab_name for r in export.collect()] == ["Blood - Glucose"]
    with pytest.raises(review.NotReady, match=r"a.pdf: 2 pending row\(s\), 1 unresolved missing-row marker\(s\)"):
        lab.strict_export(rows, context, log, markers)


def test_refresh_rebuilds_only_when_a_cache_grows(spark, run):
    rows, context = run
    names = lambda asked: [(n, s, "Blood - Glucose") for n, s in asked]
    units = lambda asked: [(u, n, "g/L" if u else "nonsense") for u, n in asked]
    built = []

    def export(rows, context):
        built.append(1)
        return rows

    _, grown = lab.refresh_and_export(rows, context, names, units, export)
    assert len(built) == 2 and {r.key for r in grown.name_cache.collect()} == {"glicose", "células", "novo"}
    assert ("g/l|blood - glucose", "g/L") in {(r.key, r.unit) for r in grown.unit_cache.collect()}
    nothing = lambda asked: []
    assert lab.refresh_and_export(rows, grown, nothing, nothing, export)[1] is grown and len(built) == 3
    assert not refresh.refresh(rows, grown.name_cache, grown.unit_cache, grown.specs, nothing, nothing, "result_index")[2]


def test_a_retry_asks_nothing_twice(spark, tmp_path):
    """Tasks that were done before one failed have their answers kept; the second run asks the rest."""
    misses = spark.createDataFrame([(f"k{i}", f"name {i}", None) for i in range(60)], "key string, raw_lab_name string, raw_section_name string")
    seen, trap = tmp_path / "seen", tmp_path / "trap"
    seen.mkdir()
    trap.write_text("")

    def mapper(rows):
        out = []
        for name, section in rows:
            if name == "name 7" and trap.exists():
                import time

                time.sleep(6)  # the other tasks get done
                raise RuntimeError("no answer")
            out.append((name, section, f"lab of {name}"))
        with open(seen / uuid.uuid4().hex, "w") as f:
            f.write("\n".join(n for n, _ in rows))
        return out

    with pytest.raises(Exception, match="no answer"):
        refresh.asked(misses, ["raw_lab_name", "raw_section_name"], mapper, "lab_name", str(tmp_path / "answers"))
    first = [n for f in seen.iterdir() for n in f.read_text().split("\n")]
    trap.unlink()
    got = refresh.asked(misses, ["raw_lab_name", "raw_section_name"], mapper, "lab_name", str(tmp_path / "answers"))
    assert {r.key: r.lab_name for r in got.collect()} == {f"k{i}": f"lab of name {i}" for i in range(60)}
    every = [n for f in seen.iterdir() for n in f.read_text().split("\n")]
    assert 0 < len(first) < 60 and len(every) == len(set(every)) == 60


def test_ordered_files_make_one_sorted_file(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7 % 100 if i % 9 else None, f"t{i}, x") for i in range(200)], "n int, t string")
    sinks.write_ordered_csv(rows, str(tmp_path / "out"), ["n", "t"], files=5)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in parts)
    assert len([p for p in parts if p.stat().st_size]) > 2 and text.split("\n")[0] == "n,t"
    assert text.split("\n")[1:-1] == [r.line for r in sinks.canonical_lines(rows, ["n", "t"]).collect()]


def test_the_second_run_reads_only_new_files(spark, tmp_path):
    docs, ledger = tmp_path / "docs", str(tmp_path / "ledger")
    docs.mkdir()
    for name, text in (("a.pdf", "one"), ("b.pdf", "two"), ("copy.pdf", "one")):
        (docs / name).write_text(text)
    new = lambda: sorted(r.document.rsplit("_", 1)[0] for r in pages.discover_new(spark, str(docs), ledger).collect())
    assert new() == ["a", "b"] and new() == []
    (docs / "c.pdf").write_text("three")
    (docs / "d.pdf").write_text("two")
    assert new() == ["c"] and spark.read.parquet(ledger).count() == 5 and new() == []


def test_a_list_of_documents_is_counted_as_it_is_written(spark, tmp_path):
    for stem, failed in (("a", False), ("b", True), ("c", False)):
        d = tmp_path / "in" / f"{stem}_0a1b2c3d"
        d.mkdir(parents=True)
        (d / f"{stem}.001.json").write_text(json.dumps({"lab_results": [{"raw_lab_name": "x"}], "_extraction_failed": failed}))
    run = lambda stems: pages.read_documents(spark, str(tmp_path / "in"), stems, str(tmp_path / "out"))
    assert run(["a", "b", "a", "nobody"]) == {"rows": 2, "read": 1, "failed": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(sinks.NothingSucceeded):
        run(["b"])
    assert run(["nobody"])["rows"] == 0


def test_specifications_round_trip(spark):
    s = Specs.from_dict(spark, Specs.from_dict(spark, CONFIG).to_dict())
    assert s.to_dict() == Specs.from_dict(spark, CONFIG).to_dict() and list(s.to_dict()) == sorted(CONFIG)


def test_snapshots(spark, tmp_path):
    for name, text in (("a.csv", "source_file,page_number,result_index,x\na.pdf,1,0,5\n"), ("b.csv", "source_file,page_number,result_index,y\nb.pdf,2,1,7\n"), ("c.csv", "other\n1\n"), ("empty.csv", "")):
        (tmp_path / name).write_text(text)
    path = lambda n: str(tmp_path / n)
    assert [snapshots.reusable_snapshot(spark, path(n)) for n in ("a.csv", "c.csv", "empty.csv", "none.csv")] == [True, False, False, False]
    assert snapshots.load_snapshot(spark, path("empty.csv")) == (None, [f"snapshot is empty: {path('empty.csv')}"])
    assert "not found" in snapshots.load_snapshot(spark, path("none.csv"))[1][0]
    merged = snapshots.merge_snapshots(spark, [path("a.csv"), path("b.csv"), path("a.csv"), path("none.csv")], skip_missing=True)
    assert sorted((r.source_file, r.x, r.y) for r in merged.collect()) == [("a.pdf", "5", None), ("b.pdf", None, "7")]
    with pytest.raises(FileNotFoundError):
        snapshots.merge_snapshots(spark, [path("none.csv")])
    assert snapshots.use_or_build(merged, None).count() == 2 and snapshots.use_or_build(merged, merged).count() == 4
    (tmp_path / "specs.json").write_text('{"a": 1}')
    assert snapshots.copy_text(spark, path("specs.json"), path("copy")) and spark.read.text(path("copy")).first().value == '{"a": 1}'
    assert not snapshots.copy_text(spark, path("nothing.json"), path("copy2"))


def test_as_many_jobs_for_many_snapshots_as_for_one(spark, tmp_path):
    texts = ['source_file,page_number,result_index,v%d\n"a, ""b""\nc",1,%d,\n\nx,2,3\n' % (i % 3, i) for i in range(40)]
    paths = []
    for i, t in enumerate(texts):
        (tmp_path / f"s {i}.csv").write_text(t)
        paths.append(str(tmp_path / f"s {i}.csv"))

    def jobs(paths):
        group = f"g{len(paths)}"
        spark.sparkContext.setJobGroup(group, group)
        rows = snapshots.merge_snapshots(spark, paths).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), rows

    (one, first), (many, rows) = jobs(paths[:1]), jobs(paths)
    assert many <= one + 1 and len(rows) == 80  # files in large numbers are listed by a job
    assert rows[0].__fields__ == ["source_file", "page_number", "result_index", "v0", "v1", "v2"]
    assert [tuple(r) for r in first] == [('a, "b"\nc', "1", "0", None), ("x", "2", "3", None)]
    assert snapshots.load_snapshot(spark, paths[0])[1] == [f"1 malformed line(s): {paths[0]}"]
    spark.createDataFrame([(1, 'q"q,')], "source_file int, page_number string").write.option("header", "true").csv(str(tmp_path / "written"))
    assert [tuple(r) for r in snapshots.merge_snapshots(spark, [str(tmp_path / "written")]).collect()] == [("1", 'q"q,')]
    assert {r.path: r.has_columns for r in snapshots.reusable_snapshots(spark, [paths[3], "/nowhere.csv"]).collect()} == {paths[3]: True, "/nowhere.csv": False}


def test_approved_cases(spark, tmp_path):
    for case, meta, files in (("one", {"stem": "s", "file_hash": "h", "original_filename": "o"}, 3), ("two", {"stem": "s", "file_hash": "h", "original_filename": "o"}, 3), ("three", {"stem": "t"}, 3), ("four", {"stem": "u"}, 2)):
        d = tmp_path / "cases" / case
        d.mkdir(parents=True)
        (d / "case.json").write_text(json.dumps(meta))
        for name in ("document.pdf", "expected.csv")[: files - 1]:
            (d / name).write_text("x")
    cases = snapshots.approved_cases(spark, str(tmp_path / "cases"))
    assert sorted((r.case_id, r.fault) for r in snapshots.case_faults(cases).collect()) == [("four", "missing required files: expected.csv"), ("one", "stem repeats: s"), ("three", "incomplete metadata"), ("two", "stem repeats: s")]
    rows = spark.createDataFrame([("s", "s.pdf", 1, 0, "accepted"), ("s", "s.pdf", 1, 1, None)], "stem string, source_file string, page_number int, result_index int, review_status string")
    snapshots.write_cases(rows, cases.filter("case_id = 'one'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "review_state")).count() == 1 and spark.read.option("header", "true").csv(str(tmp_path / "out" / "expected")).count() == 2
