import math

import pytest
from pyspark.sql import functions as F

from assayflow.functions import dates, numeric, text as T


def ask(spark, expression, rows, schema="x string"):
    """The expression's value for each row."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


X = lambda: F.col("x")


def test_clean_number(spark):
    cases = {"13 .0": "13.0", "4 ,04": "4.04", " 0 , 60 ": "0.60", "Ca. 15": "15", "0.9=": "0.9", "52.6=1946": "52.6", "256 000": "256000", "1,234.5": "1.234.5", "aprox. 7": "7", "cerca de 3": "3"}
    assert ask(spark, numeric.clean_number(X()), list(cases)) == list(cases.values())


@pytest.mark.parametrize("raw,value,below,above", [
    ("<0.05", 0.05, True, False), ("< 10", 10.0, True, False), ("<20=NR", 20.0, True, False), ("> 3,5", 3.5, False, True), ("1 a 2/campo", 1.5, False, False),
    ("0 - 2", 1.0, False, False), ("1-5 / campo", 3.0, False, False), ("5-1", None, False, False), ("1,234.5", None, False, False), ("1 234,5", None, False, False),
    ("1d", None, False, False), ("nan", None, False, False), ("NEGATIVO", None, False, False), (None, None, False, False), ("", None, False, False), ("1e3", 1000.0, False, False),
])
def test_parse_value(spark, raw, value, below, above):
    (got,) = ask(spark, numeric.parse_value(X()), [raw])
    assert (got.value, got.is_below_limit, got.is_above_limit) == (value, below, above)


def test_infinite_and_suffixed_numbers(spark):
    got = ask(spark, numeric.safe_double(X()), ["inf", "-Infinity", "1f", " 2. ", ".5", "+3", "x"])
    assert got == [math.inf, -math.inf, None, 2.0, 0.5, 3.0, None]


def test_numeric_field(spark):
    assert ask(spark, numeric.numeric_field(X()), ["1,5", "1,234.5", "12, comments: low", "7, raw_comments: x", "abc", None]) == [1.5, None, 12.0, 7.0, None, None]


def test_parse_range(spark):
    got = ask(spark, numeric.parse_range(X(), F.col("b")), [("3.5-5.0", False), ("negative", True), ("yes", True), ("negative", False), ("7", False), ("a-b", False)], "x string, b boolean")
    assert [g and (g["min"], g["max"]) for g in got] == [(3.5, 5.0), (0.0, 0.0), (1.0, 1.0), None, (7.0, 7.0), None]


def test_qualitative(spark):
    cases = {
        "Límpido": 0, "Não detetado": 0, "Cultura estéril após incubação": 0, "Amarela ouro": 0, "(*)": 1, "1+": 1, "Raras células": 1, "DUVIDOSO": None, "traço": 1 if False else None,
        "não reactivo": None, "non-reactive": None, "gram negativo": 1, "": None, "nan": None, " Positivo ": 1, "+++": 1, "distendida, apresenta paredes finas e lisas": 0, "vestígios": 1, "r": 1, "ra": None,
    }
    assert ask(spark, T.classify_qualitative(X()), list(cases)) == list(cases.values())


def test_folding(spark):
    assert ask(spark, T.fold(X()), ["  ÁÉÍ ñ ç ", "x³ º", "ﬁm", "é", "ß"]) == ["aei n c", "x3 o", "fim", "e", "ß"]


def test_keys(spark):
    assert ask(spark, T.unit_key(X()), ["", "nan", None, "x109/L", "X10 12/l", "x10^9/L", " mg/dL "]) == ["null", "null", "null", "x10^9/l", "x10^12/l", "x10^9/l", "mg/dl"]
    pair = [(" Glicose ", "Elementos Anormais"), ("Glicose", None), ("Glicose", " NaN ")]
    assert ask(spark, T.cache_key(X(), F.col("s")), pair, "x string, s string") == ["glicose|elementos anormais", "glicose", "glicose"]
    assert ask(spark, T.legacy_cache_key(X(), F.col("s")), pair, "x string, s string") == ["elementos anormais - glicose", "glicose", "glicose"]
    assert ask(spark, T.folded_key(X()), ["Ferritiná|I M U N O", "bioquímica - Ferro - x", "Só isto", "a b"]) == ["ferritina|imuno", "bioquimica - ferro - x", "so isto", "a b"]


def test_unit_looks(spark):
    assert ask(spark, T.unit_looks_percent(X()), ["%", "Percent", "mg", None]) == [True, True, False, False]
    assert ask(spark, T.unit_looks_absolute(X()), ["10^9/L", "x 10³/", "V.abs.", "/mm3", "mg/dL", None, "x10E3/µl"]) == [True, True, True, True, False, False, True]


def test_reasons(spark):
    add = T.append_reason(X(), F.col("w"), "A_CODE")
    assert ask(spark, add, [("", True), ("A_CODE; ", True), ("B; ", True), (None, False), ("B; ", None)], "x string, w boolean") == ["A_CODE; ", "A_CODE; ", "B; A_CODE; ", "", "B; "]
    assert ask(spark, T.remove_reason(X(), "A"), ["A; B; ", "A; ", "", None]) == ["B; ", "", "", ""]
    assert ask(spark, T.status_label(X()), [" Accepted", "rejected", "maybe", "", None]) == ["accepted", "rejected", "pending", "pending", "pending"]


def test_row_ids_come_back(spark):
    rows = [("a file.pdf", 1, 2), ("f" * 100, 30, 400), ("é.pdf", 0, 0)]
    both = F.struct(T.row_id(X(), F.col("p"), F.col("n")).alias("id"), T.decode_row_id(T.row_id(X(), F.col("p"), F.col("n"))).alias("back"))
    for (name, page, index), got in zip(rows, ask(spark, both, rows, "x string, p long, n long")):
        assert (got.back.source_file, got.back.page_number, got.back.result_index) == (name, page, index)
        assert not set(got.id) & set("+/=\r\n")


def test_dates(spark):
    assert ask(spark, dates.iso_date(X()), ["27/12/2001", "27-12-2001", "2001-12-27", "0000-00-00", "", "soon", None, "99/99/2001"]) == ["2001-12-27"] * 3 + [None] * 4 + ["2001-99-99"]
    pairs = [("2024-01-05", "2024-02-01"), ("", "2024-02-01"), ("0000-00-00", "2024-02-01"), (None, None)]
    assert ask(spark, dates.page_date(X(), F.col("r")), pairs, "x string, r string") == ["2024-01-05", "2024-02-01", None, None]
    assert ask(spark, dates.name_date(X()), ["exam 2020-03-04 b", "none"]) == ["2020-03-04", None]


def test_flags(spark):
    rows = [(1.0, 0.0, 2.0, False), (3.0, 0.0, 2.0, False), (1.0, None, None, True), (0.0, None, None, True), (5.0, None, None, False), (None, 0.0, 1.0, False), (5.0, 6.0, None, False)]
    got = ask(spark, numeric.abnormal(F.col("v"), F.col("a"), F.col("b"), F.col("f")), rows, "v double, a double, b double, f boolean")
    assert got == [False, True, True, False, None, None, True]


def test_scores(spark):
    rows = [(1.5, 6.0, None, 2.0, 8.0), (None, None, 5.0, 2.0, 8.0), (None, None, None, 2.0, 8.0), (0.0, None, None, 0.0, None)]
    got = ask(spark, numeric.range_score(*(F.col(c) for c in "abcde")), rows, "a double, b double, c double, d double, e double")
    assert got == [pytest.approx((0.25 + 0.25) / 2), 0.0, None, 0.0]


def test_boxes(spark):
    rows = [(0.1, 0.1, 0.5, 0.5), (100.0, 100.0, 500.0, 500.0), (1200.0, 10.0, 1500.0, 20.0), (10.0, 10.0, 5.0, 20.0)]
    scale = numeric.scale_box([F.col(c) for c in "abcd"], F.lit(1000), F.lit(2000))
    got = ask(spark, scale, rows, "a double, b double, c double, d double")
    assert [g and tuple(g) for g in got] == [(100, 200, 500, 1000), (100, 200, 500, 1000), (999, 10, 1000, 20), None]
    like = numeric.column_like_box(*(F.col(c) for c in "abcd"))
    assert ask(spark, like, [(0.0, 0.0, 40.0, 250.0), (0.0, 0.0, 41.0, 250.0), (0.0, 0.0, None, 250.0)], "a double, b double, c double, d double") == [True, False, False]
    clean = F.array(*numeric.clean_box([F.col(c) for c in "abcd"]))
    assert ask(spark, clean, [("1", "2", "3", None), ("1", "2", "3", "4,5")], "a string, b string, c string, d string") == [[None] * 4, [1.0, 2.0, 3.0, 4.5]]


def test_fences_and_their_json(spark):
    texts = ["```json\n{\"b\": 1,\n \"a\": [2]}\n```", "```\nx\n```\ny", "a ```", " {} ", "```", "```json5\n[1, 2]", "", None, "nan", "```\n\n```  "]
    assert ask(spark, T.strip_fences(X()), texts) == ['{"b": 1,\n "a": [2]}', "x\n```\ny", "a ```", " {} ", "", "[1, 2]", "", None, "nan", ""]
    assert ask(spark, T.json_or(X(), F.lit("-")), texts) == ['{"a":[2],"b":1}', "-", "-", "{}", "-", "[1,2]", "-", "-", "-", "-"]


def test_folder_stems(spark):
    pairs = [("scan_1_0a1B2c3d", None), ("scan_1", None), ("_0a1b2c3d", None), ("f_0a1b2c3d", "g.h.pdf"), ("f_0a1b2c3x", None), (None, None)]
    assert ask(spark, T.folder_stem(X(), F.col("s")), pairs, "x string, s string") == ["scan_1", "scan_1", "_0a1b2c3d", "g.h", "f_0a1b2c3x", None]
