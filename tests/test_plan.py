import json

import pytest
from pyspark.sql import functions as F

from assayflow.operators import refresh, reports
from assayflow.operators.specs import Specs
from assayflow.plans import lab
from assayflow.sources import pages, sinks

CONFIG = {
    "Blood - Glucose": dict(lab_type="blood", primary_unit="mg/dL", loinc_code="1-1", alternatives=[{"unit": "g/L", "factor": 100.0}], biological_max=600, ranges={"default": [70, 100], "male": [70, 90]}),
    "Blood - HIV": dict(lab_type="blood", primary_unit="boolean", loinc_code="2-2"),
    "Blood - Cells": dict(lab_type="blood", primary_unit="10⁹/L", loinc_code="3-3", ranges={"default": [2, 8]}),
    "Blood - Cells (%)": dict(lab_type="blood", primary_unit="%", loinc_code="3-4", ranges={"default": [40, 75]}),
}


def row(name, value, unit=None, status="accepted", **more):
    return dict(raw_lab_name=name, raw_value=value, raw_lab_unit=unit, review_status=status, bbox_left=1.0, bbox_top=1.0, bbox_right=2.0, bbox_bottom=2.0) | more


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    docs = {
        "a": [row("Glicose", "92", "mg/dL", raw_reference_min=70, raw_reference_max=99), row("Glicose", "0,93", "g/L"), row("HIV", "Não reagente"), row("Outro", "3", "x")],
        "b": [row("Glicose", "700", "mg/dL"), row("Celulas", "55", "%"), row("Glicose", "88", "mg/dL", "rejected"), row("Glicose", "<90", "mg/dL", None)],
    }
    for i, (stem, results) in enumerate(docs.items()):
        d = root / f"{stem}_0a1b2c3d"
        d.mkdir()
        (d / f"{stem}.001.json").write_text(json.dumps(dict(collection_date=f"2024-01-0{i + 1}", lab_results=results)))
    names = spark.createDataFrame([("glicose", "Blood - Glucose"), ("hiv", "Blood - HIV"), ("celulas", "Blood - Cells")], "key string, lab_name string")
    units = spark.createDataFrame([("mg/dl|blood - glucose", "mg/dL"), ("%|blood - cells (%)", "%")], "key string, unit string")
    context = lab.Context(Specs.from_dict(spark, CONFIG), names, units)
    return lab.read_rows(spark, str(root)), context


def test_ledger(run):
    rows, context = run
    got = {(r.source_file, r.result_index): r for r in lab.review_ledger(rows, context).collect()}
    assert len(got) == 8
    assert (got["a.pdf", 1].value, got["a.pdf", 1].lab_unit) == (pytest.approx(93.0), "mg/dL")
    assert (got["a.pdf", 2].lab_name, got["a.pdf", 2].value) == ("Blood - HIV (Qualitative)", 0.0)
    assert got["a.pdf", 3].review_reason == "UNKNOWN_LAB_MAPPING; "
    assert got["b.pdf", 1].lab_name == "Blood - Cells (%)"
    assert "IMPOSSIBLE_VALUE" in got["b.pdf", 0].review_reason and "DUPLICATE_ENTRY" in got["b.pdf", 0].review_reason
    assert got["b.pdf", 3].is_below_limit and got["b.pdf", 3].value == 90.0


def test_export(run):
    rows, context = run
    got = sorted((str(r.date), r.lab_name, r.value) for r in lab.final_export(rows, context).collect())
    assert got == [("2024-01-01", "Blood - Glucose", 92.0), ("2024-01-01", "Blood - HIV (Qualitative)", 0.0), ("2024-01-02", "Blood - Cells (%)", 55.0), ("2024-01-02", "Blood - Glucose", 700.0)]
    assert lab.final_export(rows, context, allow_pending=True).count() == 4
    assert lab.final_export(rows.limit(0), context).collect() == []
    with pytest.raises(ValueError):
        lab.prepare_rows(rows, context, "other")


def test_decisions_change_the_export(spark, run):
    rows, context = run
    log = spark.createDataFrame([("b.pdf", 1, 0, "accepted", "1"), ("b.pdf", 1, 0, "rejected", "2"), ("b.pdf", 1, 2, "accepted", "1")], "source_file string, page_number int, result_index int, status string, decided_at string")
    assert [(r.lab_name, r.value) for r in lab.final_export(rows, context, log).collect()] == [("Blood - Glucose", 88.0)]


def test_explorer(run):
    rows, context = run
    got = {(r.source_file, r.result_index): r for r in lab.explorer_view(lab.review_ledger(rows, context), context, "male", 40).collect()}
    assert got["a.pdf", 0].is_out_of_reference is False and got["a.pdf", 0].is_out_of_optimal_range is True
    assert got["a.pdf", 0].reference_text == "70.0 - 99.0" and got["a.pdf", 1].reference_text == ""


def test_refresh(spark, run, tmp_path):
    rows, context = run

    def mapper(contexts):
        with open(tmp_path / "asked", "a") as f:  # the mapper runs in tasks
            f.writelines(f"{c}\n" for c in contexts)
        return [(n, s, "Blood - Cells" if n == "Outro" else "nonsense") for n, s in contexts]

    out = refresh.refresh_names(rows, context.name_cache, context.specs, mapper, "result_index")
    assert (tmp_path / "asked").read_text() == "('Outro', None)\n"
    assert {r.key: r.lab_name for r in out.collect()}["outro"] == "Blood - Cells"
    assert {(r.raw_unit, r.lab_name) for r in refresh.missing_units(rows, context.name_cache, context.unit_cache).collect()} == {("g/L", "Blood - Glucose"), ("", "Blood - HIV"), ("%", "Blood - Cells")}


def test_reports(run):
    rows, context = run
    ledger = lab.review_ledger(rows, context)
    assert [(r.raw_lab_name, r.n) for r in reports.unknown_counts(ledger).collect()] == [("Outro", 1)]
    assert reports.unknown_shares(ledger).first().distinct_labs == 1
    assert reports.codes_of_several_labs(context.specs).count() == 0
    assert {r.category: r.n for r in reports.categorize(rows, "raw_lab_name", [("sugar", "glic"), ("any", ".")]).collect()} == {"sugar": 5, "any": 3}
    assert reports.top(reports.categorize(rows, "raw_lab_name", [("sugar", "glic")])).first().category == "sugar"


def test_sinks(spark, run, tmp_path):
    rows, context = run
    export = lab.final_export(rows, context)
    lines = [r.line for r in sinks.canonical_lines(export.select("lab_name", "value", "review_needed", "lab_type"), ["lab_name"]).collect()]
    assert lines[0].startswith("Blood - Cells (%),55.0,")
    sinks.write_table(export, str(tmp_path / "t"), "csv", ["source_file"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 4
    sinks.write_cache(context.name_cache, str(tmp_path / "names"))
    assert sorted(spark.read.json(str(tmp_path / "names")).collect()) == sorted(context.name_cache.collect())
    assert sinks.decision_snapshot(rows).count() == 7
    quoted = spark.createDataFrame([('a"b,c',), (None,)], "x string")
    assert [r.line for r in sinks.canonical_lines(quoted, ["x"]).collect()] == ["", '"a""b,c"']


def test_command_line(spark, tmp_path):
    from assayflow.__main__ import main

    d = tmp_path / "p" / "a_0a1b2c3d"
    d.mkdir(parents=True)
    (d / "a.001.json").write_text(json.dumps(dict(collection_date="2024-01-01", lab_results=[row("Glicose", "92", "mg/dL")])))
    (tmp_path / "specs.json").write_text(json.dumps(CONFIG))
    (tmp_path / "names.json").write_text(json.dumps({"glicose": "Blood - Glucose"}))
    (tmp_path / "units.json").write_text(json.dumps({"mg/dl|blood - glucose": "mg/dL"}))
    arg = lambda *names: [x for n in names for x in (f"--{n.split('=')[0]}", str(tmp_path / n.split("=")[1]))]
    main(["export", *arg("pages=p", "specs=specs.json", "names=names.json", "units=units.json", "out=o")])
    assert [r.value for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [92.0]
    assert pages.read_pages(spark, str(tmp_path / "p")).select(F.count(F.lit(1)).alias("n")).first().n == 1
