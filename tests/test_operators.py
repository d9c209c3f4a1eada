import pytest
from pyspark.sql import functions as F

from assayflow.operators import dedup, integrity, normalize, review, standardize, validate
from assayflow.operators.specs import Specs, spec_violations

U = "Urine Type II - "
CONFIG = {
    U + "Proteins": dict(lab_type="urine", primary_unit="mg/dL", loinc_code="1-1"),
    U + "Proteins (Qualitative)": dict(lab_type="urine", primary_unit="boolean", loinc_code="1-2"),
    U + "Ketones": dict(lab_type="urine", primary_unit="mg/dL", loinc_code="1-3"),
    U + "Ketones (Qualitative)": dict(lab_type="urine", primary_unit="boolean", loinc_code="1-4"),
    U + "Sediment - Leukocytes": dict(lab_type="urine", primary_unit="/field", loinc_code="1-5", alternatives=[{"unit": "/campo", "factor": 1.0}]),
    U + "Sediment - Leukocytes (Absolute)": dict(lab_type="urine", primary_unit="/µL", loinc_code="1-6"),
    U + "Sediment - Epithelial Cells": dict(lab_type="urine", primary_unit="/field", loinc_code="1-7", alternatives=[{"unit": "/campo", "factor": 1.0}]),
    "Blood - Lymphocytes": dict(lab_type="blood", primary_unit="10⁹/L", loinc_code="2-1", alternatives=[{"unit": "/mm3", "factor": 0.001}], ranges={"default": [1.5, 4.0]}),
    "Blood - Lymphocytes (%)": dict(lab_type="blood", primary_unit="%", loinc_code="2-2", ranges={"default": [20, 45]}),
    "Blood - pH": dict(lab_type="blood", primary_unit="pH", loinc_code="2-3"),
    "Blood - HIV": dict(lab_type="blood", primary_unit="boolean", loinc_code="2-4"),
}
ROW = "raw_lab_name string, raw_section_name string, raw_value string, raw_comments string, raw_lab_unit string, raw_reference_min double, raw_reference_max double, lab_name_standardized string, lab_unit_standardized string"


@pytest.fixture(scope="module")
def specs(spark):
    return Specs.from_dict(spark, CONFIG)


def normalized(spark, specs, lab, unit, value, section=None, comments=None):
    row = spark.createDataFrame([("x", section, value, comments, unit, 1.0, 2.0, lab, unit)], ROW)
    r = normalize.normalize(row, specs).first()
    return r.lab_name_standardized, r.lab_unit_primary, r.value_primary


@pytest.mark.parametrize("lab,unit,value,section,want", [
    ("Proteins", None, "NEGATIVO", None, ("Proteins (Qualitative)", "boolean", 0.0)),
    ("Proteins", "mg/dL", "30", "Bioquímica", ("Proteins", "mg/dL", 30.0)),
    ("Ketones", "mg/dL", "10", "ANÁLISE SUMÁRIA DA URINA", ("Ketones (Qualitative)", "boolean", 1.0)),
    ("Ketones", "mg/dL", "0,00", "Exame Sumário", ("Ketones (Qualitative)", "boolean", 0.0)),
    ("Sediment - Leukocytes", "/ul", "1-5 / campo", "Sedimento urinário", ("Sediment - Leukocytes", "/field", 3.0)),
    ("Sediment - Epithelial Cells", "/ul", "Raras", "Sedimento", ("Sediment - Epithelial Cells", "/field", None)),
    ("Sediment - Leukocytes", "/µL", "17", "Sedimento", ("Sediment - Leukocytes (Absolute)", "/µL", 17.0)),
])
def test_normalization(spark, specs, lab, unit, value, section, want):
    assert normalized(spark, specs, U + lab, unit, value, section) == (U + want[0], *want[1:])


def test_units_and_words(spark, specs):
    assert normalized(spark, specs, "Blood - Lymphocytes", "/mm3", "1350") == ("Blood - Lymphocytes", "10⁹/L", pytest.approx(1.35))
    assert normalized(spark, specs, "Blood - Lymphocytes", "odd", "5") == ("Blood - Lymphocytes", "odd", 5.0)
    assert normalized(spark, specs, "Blood - HIV", "boolean", "Não reagente") == ("Blood - HIV", "boolean", 0.0)
    assert normalized(spark, specs, "Blood - HIV", "boolean", "0.2", comments="Positivo") == ("Blood - HIV", "boolean", 1.0)
    assert normalized(spark, specs, "Blood - pH", "pH", "negativo") == ("Blood - pH", "pH", 0.0)


CACHES = [
    ({"glicose": "B", "glicose|elementos anormais": "U"}, ("Glicose", "Elementos anormais"), "U"),
    ({"glicose": "B", "glicose|elementos anormais": "U"}, ("Glicose", None), "$UNKNOWN$"),
    ({"bioquímica - 25 hidroxivitamina d (x)": "D"}, ("25 Hidroxivitamina D (x)", "Bioquímica"), "D"),
    ({"ferritina": "F", "bioquimica - ferritina": "F"}, ("Ferritina", "Metabolismo do Ferro"), "F"),
    ({"glicose": "B", "glicose|elementos anormais": "U"}, ("Glicose", "Bioquímica"), "$UNKNOWN$"),
    ({"tsh|imunologia": "T"}, ("TSH", "I M U N O L O G I A"), "T"),
    ({"leucocitos": "B", "leucocitos|exame": "S"}, ("LEUCOCITOS", "Sedimento urinário"), "$UNKNOWN$"),
]


@pytest.mark.parametrize("cache,context,want", CACHES)
def test_name_cache(spark, cache, context, want):
    if context == ("Glicose", None):
        want = "B"  # without a section the bare key is the exact one
    rows = spark.createDataFrame([context], "raw_lab_name string, raw_section_name string")
    table = spark.createDataFrame(list(cache.items()), "key string, lab_name string")
    assert standardize.standardize_names(rows, table).first().lab_name_standardized == want


def test_units_follow_their_rules(spark, specs):
    rows = spark.createDataFrame([("Blood - pH", ""), ("Blood - Lymphocytes", "/MM3"), ("Blood - Lymphocytes (%)", None), ("$UNKNOWN$", "x"), ("Blood - HIV", "y")], "lab_name_standardized string, raw_lab_unit string")
    cache = spark.createDataFrame([("/mm3|blood - lymphocytes", "10⁹/L")], "key string, unit string")
    out = standardize.implied_units(standardize.explicit_units(standardize.standardize_units(rows, cache), specs), specs)
    assert {r.lab_name_standardized: r.lab_unit_standardized for r in out.collect()} == {"Blood - pH": "pH", "Blood - Lymphocytes": "/mm3", "Blood - Lymphocytes (%)": "%", "$UNKNOWN$": None, "Blood - HIV": "$UNKNOWN$"}


def test_full_standardization(spark, specs):
    rows = spark.createDataFrame(
        [("f", 1, "Linfócitos", None, "33", "%"), ("f", 1, "Linfócitos", None, "1,9", "10⁹/L"), ("f", 2, "HIV", None, "Negativo", None), ("f", 2, "outro", None, "1", "x")],
        "source_file string, page_number int, raw_lab_name string, raw_section_name string, raw_value string, raw_lab_unit string",
    )
    names = spark.createDataFrame([("linfocitos", "Blood - Lymphocytes"), ("hiv", "Blood - HIV")], "key string, lab_name string")
    units = spark.createDataFrame([("%|blood - lymphocytes (%)", "%")], "key string, unit string")
    got = {(r.raw_lab_name, r.raw_value): (r.lab_name_standardized, r.lab_unit_standardized) for r in standardize.standardize(rows, specs, names, units).collect()}
    assert got["Linfócitos", "33"] == ("Blood - Lymphocytes (%)", "%")
    assert got["Linfócitos", "1,9"] == ("Blood - Lymphocytes", "10⁹/L")
    assert got["HIV", "Negativo"][0] == "Blood - HIV (Qualitative)"
    assert got["outro", "1"] == ("$UNKNOWN$", None)


OBS = "source_file string, page_number int, result_index int, date date, lab_name string, value double, lab_unit string, raw_value string, reference_min double, reference_max double, is_below_limit boolean, is_above_limit boolean"


def obs(spark, rows):
    base = dict(source_file="f", page_number=1, date="2024-01-01", lab_name="Blood - A", value=1.0, lab_unit="u", raw_value=None, reference_min=None, reference_max=None, is_below_limit=False, is_above_limit=False)
    full = [base | {"result_index": i} | r for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in OBS.split(", ")) for r in full], OBS.replace("date date", "date string"))
    return df.withColumn("date", F.col("date").cast("date"))


def test_duplicates(spark):
    out = validate.duplicate_entries(obs(spark, [
        dict(value=35.0), dict(value=35.04), dict(lab_name="B", value=0.98), dict(lab_name="B", value=1.35), dict(date=None, lab_name="C"), dict(date=None, lab_name="C", value=9.0),
        dict(lab_name="D", value=None, raw_value="x"), dict(lab_name="D", value=None, raw_value="X "), dict(lab_name="E", is_below_limit=True), dict(lab_name="E"),
    ]), [])
    assert [r.result_index for r in out.filter("duplicate_entry").orderBy("result_index").collect()] == [2, 3, 8, 9]


@pytest.mark.parametrize("formula,values,want", [
    ("Blood - A + Blood - B * 2", {"Blood - A": 1.0, "Blood - B": 3.0}, 7.0), ("(Blood - A + Blood - B) / 4", {"Blood - A": 1.0, "Blood - B": 3.0}, 1.0), ("-Blood - A - 1", {"Blood - A": 5.0}, -6.0),
    ("Blood - A / Blood - B", {"Blood - A": 1.0, "Blood - B": 0.0}, None), ("Blood - A + Blood - C", {"Blood - A": 1.0}, None), ("10 - 2 - 3", {}, 5.0), ("2 * (3 + 4) / 7", {}, 2.0),
])
def test_formulas(spark, formula, values, want):
    df = spark.createDataFrame([(values,)], "v map<string,double>")
    assert df.select(validate.compile_formula(formula, F.col("v")).cast("double").alias("x")).first().x == want


def test_bad_formulas(spark):
    v = F.col("v")
    assert all(validate.compile_formula(f, v) is None for f in ("import os", "1 +", "(1", "2 ** 3", "", "1; 2", "Blood - A(1)"))


def test_validate(spark):
    s = Specs.from_dict(spark, {
        "Blood - A": dict(primary_unit="u", biological_min=0, biological_max=100, max_daily_change=5), "Blood - Total Protein": dict(primary_unit="u"),
        "_relationships": [dict(name="r", target="Blood - T", formula="Blood - X * 2", tolerance_percent=10)],
    })
    rows = [
        dict(value=-1.0), dict(value=30.0, date="2024-01-03"), dict(value=500.0, date="2024-03-01", lab_unit="%"), dict(lab_name="Blood - Albumin", value=9.0), dict(lab_name="Blood - Total Protein", value=7.0),
        dict(lab_name="Blood - Z", raw_value="12=34", value=12.0), dict(lab_name="Blood - Y", reference_min=5.0, reference_max=1.0), dict(lab_name="Blood - W", value=99.0, reference_min=1.0, reference_max=2.0),
        dict(lab_name="Blood - X", value=2.0), dict(lab_name="Blood - T", value=8.0), dict(lab_name="Blood - Anion Gap", value=-3.0), dict(value=150.0, date="2024-06-01"),
    ]
    got = {r.result_index: r.review_reason for r in validate.validate(obs(spark, rows), s).collect()}
    want = {0: "NEGATIVE_VALUE; ", 1: "TEMPORAL_ANOMALY; ", 2: "PERCENTAGE_BOUNDS; TEMPORAL_ANOMALY; ", 3: "COMPONENT_EXCEEDS_TOTAL; ", 5: "FORMAT_ARTIFACT; ", 6: "RANGE_INCONSISTENCY; ", 7: "EXTREME_DEVIATION; ", 9: "RELATIONSHIP_MISMATCH; ", 11: "IMPOSSIBLE_VALUE; "}
    assert {k: v for k, v in got.items() if v} == want


def test_review_and_publish(spark):
    rows = obs(spark, [dict(), dict(value=2.0), dict(lab_name="$UNKNOWN$"), dict(lab_name="B", lab_unit="")]).withColumns({
        "review_status": F.element_at(F.array(*map(F.lit, ["accepted", " Accepted", "accepted", "rejected"])), F.col("result_index") + 1), "review_reason": F.lit("DUPLICATE_ENTRY; "), "review_needed": F.lit(True),
        "lab_unit_standardized": F.when(F.col("result_index") == 1, "u").otherwise("v"), "primary_unit": F.lit("u"),
    })
    (kept,) = review.publish(rows, ["result_index"]).collect()
    assert (kept.value, kept.review_reason, kept.review_needed) == (2.0, "", False)
    (s,) = review.review_summary(rows).collect()
    assert (s.total, s.accepted, s.rejected, s.pending, s.fixture_ready) == (4, 3, 1, 0, True)
    assert review.export(rows.limit(0)).columns == list(review.EXPORT)


def test_dedup_and_integrity(spark):
    rows = obs(spark, [dict(value=float(v)) for v in [10] * 20 + [500]] + [dict(date=None), dict(date=None)])
    assert [r.value for r in integrity.outliers(rows.filter("date is not null")).collect()] == [500.0]
    assert dedup.first_of(rows, ["date"], ["result_index"]).count() == 2
    checks = {r.check for r in integrity.integrity_violations(rows.withColumn("key", F.col("result_index")).drop("result_index"), "key").collect()}
    assert {"no date", "repeated row", "repeated date and lab", "outlier"} <= checks


def test_spec_rules(spark, specs):
    assert spec_violations(specs).count() == 0
    bad = Specs.from_dict(spark, {"Blood - X": dict(lab_type="blood", primary_unit="%", loinc_code="", ranges={"default": [None, 99], "male": [None, None]})})
    assert {r.rule for r in spec_violations(bad).collect()} == {"loinc_code is required", "percent unit without (%) in the name", "range without bounds"}
