"""Result rows out of whatever a model returned for them.

Rows come as objects, lists of them, pairs or keys and values in turn, text of any of these, or text of one field after
another. Spark's variant type tells the shapes apart, so repair stays in the JVM; ``LEVELS`` shapes within one another
are taken apart there. What lies deeper, and literals of Python, are read by a function in Python, for those pages alone.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# ---- fixed values: the fields of a result ----------------------------------------------------------
TEXT_FIELDS = ("raw_lab_name", "raw_section_name", "raw_value", "raw_lab_unit", "raw_reference_range", "raw_comments", "review_reason", "review_status", "review_completed_at")
BOUND_FIELDS = ("raw_reference_min", "raw_reference_max")
BOX_FIELDS = ("bbox_left", "bbox_top", "bbox_right", "bbox_bottom")
# ----------------------------------------------------------------------------------------------------
RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_FIELDS] + [T.StructField(c, T.DoubleType()) for c in BOUND_FIELDS + BOX_FIELDS] + [T.StructField("review_needed", T.BooleanType())]
)
#: Shapes within shapes that the JVM takes apart.
LEVELS = 4

_LABEL = r"(?i)\b(" + "|".join([*TEXT_FIELDS[:6], *BOUND_FIELDS, *BOX_FIELDS]) + r")\s*[:=]\s*"
_AROUND = " \t\r\n,;|"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_COMMENT = r"(?i), (raw_)?comments:"


def whole_box(r: Column) -> Column:
    """A row with its four box numbers, or with none. ``r`` is repeated often: a lambda's variable, not an expression."""
    whole = r["bbox_left"].isNotNull() & r["bbox_top"].isNotNull() & r["bbox_right"].isNotNull() & r["bbox_bottom"].isNotNull()
    return F.struct(*(F.when(whole, r[c]).alias(c) if c in BOX_FIELDS else r[c].alias(c) for c in RESULT.fieldNames()))


# ---- in the JVM ------------------------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _item(v: Column, python: bool = False) -> Column:
    """A piece of a payload on its way to rows; ``python`` says that the JVM can't read it."""
    return F.struct(v.alias("v"), F.lit(python).alias("python"))


def _object(keys: Column, values: Column) -> Column:
    """An object of keys and values; of equal keys the last one counts."""
    later = lambda k, i: F.exists(F.slice(keys, i + 2, F.size(keys)), lambda other: other == k)
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("x"), F.transform(keys, later).alias("later")), lambda e: ~e["later"])
    return F.to_variant_object(F.map_from_arrays(F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: e["x"])))


def _list_rows(v: Column) -> Column:
    items = _items(v)
    even, odd = F.filter(items, lambda _, i: i % 2 == 0), F.filter(items, lambda _, i: i % 2 == 1)
    pair = lambda x: _kind(x).startswith("ARRAY") & (F.size(_items(x)) == 2) & F.coalesce(_kind(F.get(_items(x), F.lit(0))) == "STRING", F.lit(False))
    paired = (F.size(items) > 0) & F.forall(items, pair)
    in_turn = (F.size(items) > 0) & (F.size(items) % 2 == 0) & F.forall(even, lambda x: (_kind(x) == "STRING") & _text(x).isin(*RESULT.fieldNames()))
    of_pairs = _object(F.transform(items, lambda x: _text(F.get(_items(x), F.lit(0)))), F.transform(items, lambda x: F.get(_items(x), F.lit(1))))
    return F.when(paired, F.array(_item(of_pairs))).when(in_turn, F.array(_item(_object(F.transform(even, _text), odd)))).otherwise(F.transform(items, lambda x: _item(x)))


def _text_rows(v: Column) -> Column:
    text = F.regexp_replace(_text(v), r"^\s+|\s+$", "")
    inner = F.try_parse_json(text)
    labels = F.transform(F.regexp_extract_all(text, F.lit(_LABEL), F.lit(1)), F.lower)
    values = F.transform(F.slice(F.split(text, _LABEL, -1), F.lit(2), F.size(labels)), lambda x: F.btrim(x, F.lit(_AROUND)))
    packed = _object(labels, values)
    named = F.coalesce(F.try_variant_get(packed, "$.raw_lab_name", "string"), F.lit("")) != ""
    empty = F.array().cast("array<struct<v:variant,python:boolean>>")
    return (
        F.when(_kind(inner).rlike("^(OBJECT|ARRAY)"), F.array(_item(inner))).when(inner.isNull() & text.rlike(r"^[\[({]"), F.array(_item(v, True)))
        .when((F.size(labels) > 0) & named, F.array(_item(packed))).otherwise(empty)
    )


def _opened(item: Column) -> Column:
    """What one piece holds: itself if it is a row, the pieces inside, or nothing."""
    v, kind = item["v"], _kind(item["v"])
    held = F.try_variant_get(v, "$.lab_results", "variant")
    wrapper = held.isNotNull() & F.try_variant_get(v, "$.raw_lab_name", "variant").isNull()
    empty = F.array().cast("array<struct<v:variant,python:boolean>>")
    return (
        F.when(item["python"], F.array(item)).when(kind.startswith("OBJECT"), F.array(F.when(wrapper, _item(held)).otherwise(item)))
        .when(kind.startswith("ARRAY"), _list_rows(v)).when(kind == "STRING", _text_rows(v)).otherwise(empty)
    )


def _row(v: Column) -> Column:
    """A row's known fields in their types: whole numbers as text without a fraction."""
    path = lambda c, kind: F.try_variant_get(v, f"$.{c}", kind)

    def text(c: str) -> Column:
        kind, number = _kind(path(c, "variant")), path(c, "double")
        whole = (kind == "DOUBLE") & (number == F.rint(number)) & (F.abs(number) < 1e15)
        s = F.when(kind == "BOOLEAN", F.initcap(path(c, "string"))).when(whole, number.cast("long").cast("string")).otherwise(path(c, "string"))
        return F.nullif(s, F.lit("")).alias(c)

    def number(c: str) -> Column:
        kind, s = _kind(path(c, "variant")), F.regexp_replace(path(c, "string"), r"^\s+|\s+$", "")
        s = F.when(s.rlike(_COMMENT), F.trim(F.split(s, ",")[0])).otherwise(s)
        s = F.when(s.contains("."), s).otherwise(F.replace(s, F.lit(","), F.lit(".")))
        return F.when(kind == "STRING", F.when(s.rlike(_NUMBER), s.try_cast("double"))).when(kind != "BOOLEAN", path(c, "double")).alias(c)

    sure = F.when(_kind(path("review_needed", "variant")) == "BOOLEAN", path("review_needed", "boolean")).alias("review_needed")
    return F.struct(*map(text, TEXT_FIELDS), *map(number, BOUND_FIELDS + BOX_FIELDS), sure)


def pieces(text: Column) -> Column:
    """The rows of a payload's JSON text as variants, with what the JVM couldn't take apart marked."""
    whole = F.try_parse_json(text)
    first = F.when(_kind(whole).startswith("OBJECT"), F.try_variant_get(whole, "$.lab_results", "variant")).otherwise(whole)
    found = F.when(whole.isNull() & (F.trim(text) != ""), F.array(_item(F.try_parse_json(F.lit("0")), True))).when(first.isNotNull(), F.array(_item(first)))
    for _ in range(LEVELS):
        found = F.flatten(F.transform(found, _opened))
    return F.transform(found, lambda x: F.struct(x["v"].alias("v"), (x["python"] | ~_kind(x["v"]).startswith("OBJECT")).alias("python")))


def with_rows(pages: DataFrame, text: str = "text", plain: Column | None = None, read: Column | None = None) -> DataFrame:
    """``results``: an array of ``RESULT`` for each payload's JSON text. Where ``plain`` holds, ``read`` gives them already.

    Objects are rows, and one without a name that has ``lab_results`` stands for these. A list of pairs, or of known
    fields and values in turn, is a row. Text is JSON, a Python literal, or fields one after another with a name among them. All else is left out:
    numbers, other text, what was cut off. One pass; Python sees only the texts of pages that need it. A null or empty payload has no rows.
    """
    plain = F.lit(False) if plain is None else plain
    opened = pages.withColumn("_pieces", F.when(~plain, pieces(F.col(text))))
    python = F.coalesce(F.exists("_pieces", lambda x: x["python"]), F.lit(False))
    opened = opened.withColumn("_python", python)
    # Marked as not deterministic, so that no filter that Spark infers repeats the function or moves it into a generator.
    by_python = F.pandas_udf(repair_results, T.ArrayType(RESULT)).asNondeterministic()(F.when(F.col("_python"), F.col(text)))
    rows = F.coalesce(F.transform(F.transform("_pieces", lambda x: _row(x["v"])), whole_box), F.array().cast(T.ArrayType(RESULT)))
    done = rows if read is None else F.when(plain, read).otherwise(rows)
    return opened.withColumn("results", F.when(F.col("_python"), by_python).otherwise(done)).drop("_pieces", "_python")


# ---- in Python -------------------------------------------------------------------------------------
_FIELD = re.compile(_LABEL)


def _parsed(text: str):
    """JSON or a Python literal; None if neither."""
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def _packed(text: str) -> dict | None:
    """A row written as ``field: value`` one after another."""
    marks = list(_FIELD.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    row = {m[1].lower(): text[m.end() : end].strip(_AROUND) for m, end in zip(marks, ends)}
    return row if row.get("raw_lab_name") else None


def _paired(items: list) -> dict | None:
    """A row written as pairs, or as keys and values in turn."""
    if items and all(isinstance(x, list | tuple) and len(x) == 2 and isinstance(x[0], str) for x in items):
        return {k: v for k, v in items}
    if len(items) % 2 == 0 and items and all(isinstance(k, str) and k in RESULT.fieldNames() for k in items[::2]):
        return dict(zip(items[::2], items[1::2]))
    return None


def rows_in(value, depth: int = 0) -> Iterator[dict]:
    """The result rows in a payload, by the rules of ``with_rows``."""
    if depth > 20 or value is None:
        return
    if isinstance(value, dict):
        if "lab_results" in value and "raw_lab_name" not in value:
            yield from rows_in(value["lab_results"], depth + 1)
        else:
            yield value
    elif isinstance(value, list | tuple):
        row = _paired(list(value))
        if row is not None:
            yield row
        else:
            for item in value:
                yield from rows_in(item, depth + 1)
    elif isinstance(value, str):
        inner = _parsed(value.strip())
        if inner is not None and not isinstance(inner, str | int | float):
            yield from rows_in(inner, depth + 1)
        elif (row := _packed(value)) is not None:
            yield row


def _number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        text = value.strip()
        if re.search(_COMMENT, text):
            text = text.split(",")[0].strip()
        value = text.replace(",", ".") if "." not in text else text
        if not re.match(_NUMBER, value):
            return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def repair_row(row: dict) -> dict:
    """Known fields in their types: whole numbers as text without a fraction, four box numbers or none."""
    out: dict = {}
    for c in TEXT_FIELDS:
        v = row.get(c)
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        out[c] = None if v is None or v == "" else str(v)
    out |= {c: _number(row.get(c)) for c in BOUND_FIELDS}
    box = [_number(row.get(c)) for c in BOX_FIELDS]
    out |= dict(zip(BOX_FIELDS, box if None not in box else [None] * 4))
    out["review_needed"] = row.get("review_needed") if isinstance(row.get("review_needed"), bool) else None
    return out


def repair_results(texts: pd.Series) -> pd.Series:
    """For each payload's JSON text, its result rows."""
    found = []
    for text in texts:
        payload = _parsed(text) if isinstance(text, str) else None
        found.append([repair_row(r) for r in rows_in(payload.get("lab_results") if isinstance(payload, dict) else payload)])
    return pd.Series(found)
