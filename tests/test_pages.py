import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.sources import pages, repair, sinks


def results(payload):
    (rows,) = repair.repair_results(pd.Series([json.dumps(payload)]))
    return [{k: v for k, v in r.items() if v is not None} for r in rows]


G = {"raw_lab_name": "Glucose", "raw_value": "92", "raw_lab_unit": "mg/dL"}


@pytest.mark.parametrize("lab_results", [
    [G], [json.dumps(G)], json.dumps([G]), [str(G)], G, [["raw_lab_name", "Glucose", "raw_value", "92", "raw_lab_unit", "mg/dL"]], [[["raw_lab_name", "Glucose"], ["raw_value", "92"], ["raw_lab_unit", "mg/dL"]]],
    ["raw_lab_name: Glucose, raw_value: 92, raw_lab_unit: mg/dL"], [[G]], [None, G, 5, "nothing here"], json.dumps(json.dumps([G])) and [json.dumps([G])],
])
def test_rows_are_recovered(lab_results):
    assert results({"lab_results": lab_results}) == [G]


def test_packed_text_with_bounds():
    packed = "RAW_LAB_NAME = Cálcio; raw_section_name: Iões, raw_value: 2,31 | raw_lab_unit: mmol/L, raw_reference_min: 2.15, raw_reference_max: 2.55"
    (row,) = results({"lab_results": [packed]})
    assert row == {"raw_lab_name": "Cálcio", "raw_section_name": "Iões", "raw_value": "2,31", "raw_lab_unit": "mmol/L", "raw_reference_min": 2.15, "raw_reference_max": 2.55}


def test_boxes_and_types():
    a, b = results({"lab_results": [G | {"bbox_top": "17", "bbox_right": "81", "bbox_bottom": "33"}, G | {"raw_value": 7.0, "bbox_left": "8", "bbox_top": 9, "bbox_right": "64,5", "bbox_bottom": "21"}]})
    assert a == G
    assert b == G | {"raw_value": "7", "bbox_left": 8.0, "bbox_top": 9.0, "bbox_right": 64.5, "bbox_bottom": 21.0}


SHAPES = [
    [G], [json.dumps(G)], json.dumps([G]), [str(G)], G, str([G]), json.dumps(G), {"lab_results": [G, {"lab_results": [json.dumps([G])]}]}, [["raw_lab_name", "Glucose", "raw_value", 92, "raw_value", 93.0]],
    [[["raw_lab_name", "Glucose"], ["raw_value", 1e3], ["raw_lab_unit", ""]]], ["raw_lab_name: Glucose, raw_value: 92; RAW_LAB_UNIT = mg/dL |", " \n", "raw_value: 1"], [[G, [G]]], [None, G, 5, "nothing here", True],
    [json.dumps([json.dumps(G)])], [G | {"raw_reference_min": "1,5", "raw_reference_max": "1.20, raw_comments: twice", "review_needed": True}], [G | {"raw_reference_min": True, "raw_reference_max": "n/a", "review_needed": "yes", "raw_value": True}],
    [G | {"bbox_left": "8", "bbox_top": 9, "bbox_right": "64,5", "bbox_bottom": "2e1"}], [G | {"bbox_left": 8}], None, 5, "no rows", [], {}, [json.dumps(G)[:-3]], [[[[[[[[[G]]]]]]]]], ["('raw_lab_name', 'Glucose', 'raw_value', 1)"],
    [{"raw_value": 0.5}, {"raw_lab_name": "a", "raw_value": {"b": 1}}], [["a", "b"], ["c", "d"]], [["raw_lab_name"]], ["raw_lab_name: twice, raw_lab_name: Last, raw_value:"], ['{"raw_lab_name": "first", "raw_lab_name": "second"}'],
]


def test_spark_and_python_repair_alike(spark):
    texts = [json.dumps({"lab_results": s}) for s in SHAPES] + [json.dumps([G]), "{}", "", None, "{'lab_results': [1, {'raw_lab_name': 'x'}]}", '{"lab_results": [{"raw_lab_name": "cut'] + [json.dumps({"lab_results": s, "a": 1}) for s in SHAPES[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    names = repair.RESULT.fieldNames()
    got = {r.i: [tuple(x[c] for c in names) for x in r.results] for r in repair.with_rows(df).collect()}
    own = repair.repair_results(pd.Series(texts))
    for i, text in enumerate(texts):
        expected = [tuple(x[c] for c in names) for x in own[i]]
        if text and '{"b": 1}' in text:  # an object as a value: JSON here, Python's own form there
            assert [x[:2] for x in got[i]] == [x[:2] for x in expected]
            continue
        assert got[i] == expected, text


def test_python_sees_only_what_needs_it(spark):
    needs = [[str(G)], str([G]), [[[[[[[[[G]]]]]]]]], ['{"raw_lab_name": "first", "raw_lab_name": "second"}'], [json.dumps(G)[:-3]], ["('raw_lab_name', 'Glucose', 'raw_value', 1)"], SHAPES[7]]
    df = spark.createDataFrame([(i, json.dumps({"lab_results": shape})) for i, shape in enumerate(SHAPES)], "i int, text string").coalesce(1)
    seen = df.filter(F.exists(repair.pieces(F.col("text")), lambda x: x["python"])).collect()
    assert [SHAPES[r.i] for r in seen] == [s for s in SHAPES if s in needs]


@pytest.fixture()
def folder(tmp_path):
    def page(stem, n, payload, hash8="0a1b2c3d"):
        d = tmp_path / f"{stem}_{hash8}"
        d.mkdir(exist_ok=True)
        (d / f"{stem}.{n:03d}.json").write_text(payload if isinstance(payload, str) else json.dumps(payload))

    row = lambda i, **k: G | {"raw_value": str(90 + i), "bbox_left": 1.0, "bbox_top": 1.0, "bbox_right": 2.0, "bbox_bottom": 2.0} | k
    page("a", 1, {"lab_results": [row(0), row(1, review_status="accepted")], "page_number": 1})
    page("a", 2, {"collection_date": "05/01/2024", "lab_results": [row(2)], "review_missing_rows": [{"anchor_result_index": 0, "created_at": "t"}]})
    page("b 2023-05-06", 1, {"collection_date": "0000-00-00", "report_date": "2020-01-01", "_extraction_failed": True, "_failure_reason": "bad", "lab_results": ["raw_lab_name: X, raw_value: 1"]})
    page("c", 1, "not json")
    page("d", 1, "[1, 2]")
    return str(tmp_path)


def test_pages_to_rows(spark, folder):
    read = pages.with_results(pages.read_pages(spark, folder))
    assert sorted((r.stem, r.page) for r in read.collect()) == [("a", 1), ("a", 2), ("b 2023-05-06", 1)]
    rows = {(r.source_file, r.page_number, r.result_index): r for r in pages.flatten(read).collect()}
    assert sorted(rows) == [("a.pdf", 1, 0), ("a.pdf", 1, 1), ("a.pdf", 2, 0), ("b 2023-05-06.pdf", 1, 0)]
    assert {r.date for k, r in rows.items() if k[0] == "a.pdf"} == {"2024-01-05"}
    b = rows["b 2023-05-06.pdf", 1, 0]
    assert (b.date, b.review_reason, b.review_needed, b.raw_lab_name) == ("2023-05-06", "EXTRACTION_FAILED; ", True, "X")
    forward = {(r.source_file, r.page_number, r.result_index): r.date for r in pages.flatten(read, forward_only=True).collect()}
    assert forward["a.pdf", 1, 0] is None and forward["a.pdf", 2, 0] == "2024-01-05"
    assert [r.result_index for r in pages.flatten(read, ["accepted"]).collect()] == [1]
    assert [(r.source_file, r.anchor_result_index) for r in pages.missing_markers(read).collect()] == [("a.pdf", 0)]
    assert [(r.page, r.reason) for r in pages.failed_pages(read).collect()] == [("b 2023-05-06 page 1", "bad")]
    assert {r.stem: r.reusable for r in pages.reusable(read).collect()} == {"a": True, "b 2023-05-06": False}
    assert read.select(F.count_if(pages.needs_fallback(read)).alias("n")).first().n == 1
    sinks.write_pages(read, f"{folder}/written")
    again = spark.read.text(f"{folder}/written").select("stem", F.from_json("value", "lab_results array<struct<raw_lab_name:string,raw_value:string>>").alias("p"))
    assert sorted((r.stem, x.raw_lab_name, x.raw_value) for r in again.collect() for x in r.p.lab_results) == sorted((r.stem, x.raw_lab_name, x.raw_value) for r in read.collect() for x in r.results)


def test_discovery(spark, tmp_path):
    for name, data in (("B.PDF", b"x"), ("a.pdf", b"x"), ("c.pdf", b"y"), ("d.txt", b"z")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.is_copy, r.document) for r in pages.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"B.PDF", "a.pdf", "c.pdf"}
    assert sum(c for c, _ in got.values()) == 1 and got["a.pdf"][1].startswith("a_") and len(got["a.pdf"][1]) == 10


def test_fields_and_caches(spark, tmp_path):
    df = spark.createDataFrame([([("v", "drop")],)], "r array<struct<old:string,gone:string>>")
    (out,) = df.select(pages.rename_fields(F.col("r"), {"old": "new"}, ("gone",)).alias("r")).first().r
    assert out.asDict() == {"new": "v"}
    (tmp_path / "cache.json").write_text('{"a": "A", "b": "$UNKNOWN$"}')
    assert [(r.key, r.lab_name) for r in pages.load_cache(spark, str(tmp_path / "cache.json")).collect()] == [("a", "A")]


def test_malformed_boxes(spark):
    box = lambda x: (x, 0.0, x + 10, 300.0)
    cases = [[0], [0, 20], [0, 500], [0, 200, 400], []]
    kind = "array<struct<bbox_left:double,bbox_top:double,bbox_right:double,bbox_bottom:double>>"
    df = spark.createDataFrame([(i, [box(float(x)) for x in c]) for i, c in enumerate(cases)], f"i int, b {kind}")
    assert [r.m for r in df.select("i", pages.malformed_boxes(F.col("b")).alias("m")).orderBy("i").collect()] == [True, True, False, True, False]


def test_legacy_moves(spark):
    folders = spark.createDataFrame([(x,) for x in ("a", "a", "b_12345678", "c", "d", "d_99999999", "e", None)], "folder string")
    sources = spark.createDataFrame([("a.pdf", "1" * 64), ("c.pdf", "2" * 64), ("c.PDF", "3" * 64), ("d.pdf", "9" * 64), ("b_12345678.pdf", "4" * 64)], "name string, content_hash string")
    moved = lambda s: sorted(tuple(r) for r in pages.legacy_moves(folders, s).collect())
    assert moved(sources) == [
        ("a", "a_11111111", "renamed"), ("b_12345678", None, "already_migrated"), ("c", None, "source_not_found"),
        ("d", "d_99999999", "target_exists"), ("d_99999999", None, "already_migrated"), ("e", None, "source_not_found"),
    ]
    assert {s for _, _, s in moved(sources.limit(0))} == {"already_migrated", "source_not_found"}
