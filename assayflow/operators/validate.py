"""Checks that flag rows. Each returns the rows with a boolean column; ``validate`` runs them and writes the reasons.

``scope`` columns partition the windows: the document while a document is reviewed, nothing when the corpus is exported.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayflow.functions import numeric, text as T
from assayflow.functions.text import UNKNOWN
from assayflow.operators.specs import Specs, lookup

# ---- fixed values -------------------------------------------------------------------------------
NEGATIVE_ALLOWED = ("Blood - Anion Gap",)
#: Activities relative to normal, which may be up to 200 percent.
ABOVE_100_ALLOWED = (
    "Blood - Prothrombin Time (PT) (%)", "Blood - Factor II Activity (%)", "Blood - Factor V Activity (%)", "Blood - Factor VII Activity (%)",
    "Blood - Factor VIII Activity (%)", "Blood - Factor IX Activity (%)", "Blood - Factor X Activity (%)", "Blood - Factor XI Activity (%)",
    "Blood - Factor XII Activity (%)", "Blood - Protein C Activity (%)", "Blood - Protein S Activity (%)", "Blood - Antithrombin III Activity (%)",
)
#: Component and total.
COMPONENTS = (
    ("Blood - Albumin", "Blood - Total Protein"),
    ("Blood - Bilirubin Direct", "Blood - Bilirubin Total"),
    ("Blood - Bilirubin Indirect", "Blood - Bilirubin Total"),
    ("Blood - High-Density Lipoprotein Cholesterol (HDL Cholesterol)", "Blood - Total Cholesterol"),
    ("Blood - Low-Density Lipoprotein Cholesterol (LDL Cholesterol)", "Blood - Total Cholesterol"),
)
# -------------------------------------------------------------------------------------------------
OVER_TOTAL, DEVIATIONS = 1.05, 10


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def plausibility_code(value: Column, lab: Column, unit: Column, low: Column, high: Column) -> Column:
    """The first of negative, out of percentage bounds, and biologically impossible; null if none."""
    top = F.when(lab.isin(*ABOVE_100_ALLOWED), 200).otherwise(100)
    return F.when(
        value.isNotNull() & lab.isNotNull(),
        F.when((value < 0) & ~lab.isin(*NEGATIVE_ALLOWED), "NEGATIVE_VALUE")
        .when((unit == "%") & ((value < 0) | (value > top)), "PERCENTAGE_BOUNDS")
        .when(_true(value < low) | _true(value > high), "IMPOSSIBLE_VALUE"),
    )


def plausibility(df: DataFrame, specs: Specs, out: str = "plausibility_code") -> DataFrame:
    """By the exact name of a specification: aliases have no limits."""
    joined = lookup(df, specs.spec, "lab_name", "lab_name", _low="biological_min", _high="biological_max")
    return joined.withColumn(out, plausibility_code(F.col("value"), F.col("lab_name"), F.col("lab_unit"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def temporal_anomaly(df: DataFrame, limits: DataFrame, scope: list[str], order: list[str], out: str = "temporal_anomaly") -> DataFrame:
    """A change per day above the lab's limit, against the observation before; same-day rows never flag, but count as before."""
    usable = F.col("date").isNotNull() & F.col("value").isNotNull()
    joined = lookup(df, limits, "lab_name", "lab_name", _limit="max_daily_change").withColumns({"_usable": usable, "_month": F.trunc("date", "MM")})
    # A window has a month of a lab; the last observation of the month before comes from a table of months.
    key, month = [*scope, "lab_name"], [*scope, "lab_name", "_month"]
    ends = joined.filter("_usable").groupBy(*month).agg(F.max_by(F.struct("date", "value"), F.struct("date", *order)).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*key).orderBy("_month"))).drop("_end")
    window = Window.partitionBy(*month, "_usable").orderBy("date", *order)
    joined = joined.join(ends, month, "left")
    date, value = (F.when(F.lag("date").over(window).isNotNull(), F.lag(c).over(window)).otherwise(F.col(f"_before.{c}")) for c in ("date", "value"))
    rows = joined.withColumns({"_date": date, "_value": value})
    days = F.datediff("date", "_date")
    rate = F.abs(F.col("value") - F.col("_value")) / F.nullif(days, F.lit(0))
    flagged = rows.withColumn(out, _true(F.col("_usable") & (days > 0) & (rate > F.col("_limit"))))
    return flagged.select(*(c for c in df.columns if c != out), out)


def _last_of_day(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The last value of each lab and date that has both."""
    last = Window.partitionBy(*scope, "date", "lab_name").orderBy(*(F.col(c).desc() for c in order))
    rows = df.filter("date is not null and lab_name is not null and value is not null").withColumn("_n", F.row_number().over(last))
    return rows.filter("_n = 1").drop("_n")


def components_over_total(df: DataFrame, scope: list[str], order: list[str], pairs=COMPONENTS) -> DataFrame:
    """Rows (scope, order, date, lab_name, value, total_value) of components above 105 % of their total on the same date."""
    table = F.create_map(*(F.lit(x) for p in pairs for x in p))
    last = _last_of_day(df, scope, order)
    parts = last.withColumn("_total", F.try_element_at(table, F.col("lab_name"))).filter("_total is not null")
    totals = last.filter(F.col("lab_name").isin(*{t for _, t in pairs})).select(*scope, "date", F.col("lab_name").alias("_total"), F.col("value").alias("total_value"))
    return parts.join(totals, [*scope, "date", "_total"]).filter(F.col("value") > F.col("total_value") * OVER_TOTAL).drop("_total")


_NAME = re.compile(r"(?:Blood|Urine|Feces) - [^+\-*/()]+")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(@\d+)|([-+*/()]))")


def compile_formula(formula: str, values: Column) -> Column | None:
    """A formula over lab names as a Column of a map of values: null if a name is missing or a divisor is zero.

    A name reaches to the next operator or parenthesis. None if anything but numbers, names, + - * / ( ) is in it.
    """
    names: list[str] = []

    def mark(m):
        names.append(m[0].strip())
        return f" @{len(names) - 1} "

    text, at, tokens = _NAME.sub(mark, formula).strip(), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        tokens.append(m[1] or m[2] or m[3])
        at = m.end()

    def factor(i):
        if i >= len(tokens):
            return None
        t = tokens[i]
        if t in "+-":
            inner = factor(i + 1)
            return inner and ((-inner[0] if t == "-" else inner[0]), inner[1])
        if t == "(":
            inner = total(i + 1)
            return (inner[0], inner[1] + 1) if inner and inner[1] < len(tokens) and tokens[inner[1]] == ")" else None
        if t in "*/)":
            return None
        return (F.try_element_at(values, F.lit(names[int(t[1:])])) if t[0] == "@" else F.lit(float(t))), i + 1

    def chain(i, part, signs, combine):
        left = part(i)
        while left and left[1] < len(tokens) and tokens[left[1]] in signs:
            right = part(left[1] + 1)
            left = right and (combine(tokens[left[1]], left[0], right[0]), right[1])
        return left

    def product(i):
        return chain(i, factor, "*/", lambda s, a, b: a * b if s == "*" else F.try_divide(a, b))

    def total(i):
        return chain(i, product, "+-", lambda s, a, b: a + b if s == "+" else a - b)

    out = total(0)
    return out[0] if out and out[1] == len(tokens) else None


def relationship_mismatches(df: DataFrame, relationships: list[tuple[str, str, str, float]], scope: list[str], order: list[str]) -> DataFrame:
    """``scope, date, name, target, actual, expected, difference`` where a target differs from its formula by more than the tolerance.

    Values of a date are gathered in one map, last ones winning; a map holds as many labs as a day has.
    """
    last = _last_of_day(df, scope, order)
    days = last.groupBy(*scope, "date").agg(F.map_from_entries(F.collect_list(F.struct("lab_name", "value"))).alias("_v"))
    out = None
    for name, target, formula, tolerance in relationships:
        expected = compile_formula(formula, F.col("_v"))
        if expected is None:
            continue
        actual = F.try_element_at(F.col("_v"), F.lit(target))
        rows = days.select(*scope, "date", F.lit(name).alias("name"), F.lit(target).alias("target"), actual.alias("actual"), expected.cast("double").alias("expected"))
        rows = rows.withColumn("difference", numeric.percent_difference(F.col("actual"), F.col("expected"))).filter(F.col("difference") > tolerance)
        out = rows if out is None else out.union(rows)
    return out if out is not None else days.select(*scope, "date", *(F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("target", "string"), ("actual", "double"), ("expected", "double"), ("difference", "double")))).limit(0)


def format_artifact(raw: Column, value: Column) -> Column:
    """More than four digits after the last point, or a number run together with another by an equals sign."""
    long = raw.contains(".") & (F.length(F.regexp_extract(raw, r"\.(\d+)[^.]*$", 1)) > 4)
    joined = value.isNotNull() & F.trim(F.replace(raw, F.lit(","), F.lit("."))).rlike(r"^[\d.\-+<>≤≥]+\s*=\s*\d+")
    return _true(long | joined)


def range_code(value: Column, low: Column, high: Column) -> Column:
    """Bounds the wrong way round, else a value more than ten ranges away from its range; null if neither."""
    size = high - low
    away = F.when(value < low, low - value).when(value > high, value - high).otherwise(0.0)
    return F.when(low > high, "RANGE_INCONSISTENCY").when(value.isNotNull() & (size > 0) & (away > size * DEVIATIONS), "EXTREME_DEVIATION")


def duplicate_groups(df: DataFrame, scope: list[str], raw: str = "raw_value", unit: str = "lab_unit") -> DataFrame:
    """``scope, date, lab_name`` of those with several rows that don't say the same. Null dates or labs are never grouped.

    The same: equal limit signs, and values within the larger of 0.1 and one percent, or one raw text in one unit. All of it
    are least and greatest values and counts, so a lab that everyone has on a day is one row of each task.
    """
    r, n = F.lower(F.trim(F.col(raw))), F.count(F.lit(1)).alias("_n")
    ends = {"v": F.col("value"), "below": F.col("is_below_limit"), "above": F.col("is_above_limit"), "raw": r, "unit": F.col(unit)}
    found = [f(c).alias(f"_{kind}_{k}") for k, c in ends.items() for kind, f in (("low", F.min), ("high", F.max))]
    groups = df.filter("date is not null and lab_name is not null").groupBy(*scope, "date", "lab_name").agg(n, F.count("value").alias("_values"), F.count(r).alias("_raws"), *found)
    low, high = (lambda k: F.col(f"_low_{k}")), (lambda k: F.col(f"_high_{k}"))
    signs = (low("below") == high("below")) & (low("above") == high("above"))
    near = (F.col("_values") == F.col("_n")) & (high("v") - low("v") <= F.greatest(F.lit(0.1), 0.01 * F.greatest(F.lit(1.0), F.abs(low("v")), F.abs(high("v")))))
    text = (F.col("_raws") == F.col("_n")) & (low("raw") == high("raw")) & low("unit").eqNullSafe(high("unit"))
    return groups.filter((F.col("_n") > 1) & ~(_true(signs) & (_true(near) | _true(text)))).select(*scope, "date", "lab_name")


def in_groups(df: DataFrame, groups: DataFrame, out: str) -> DataFrame:
    """``out``: whether a row's ``groups`` columns are those of a group; null equals null. A group is one row of the join."""
    keys = groups.columns
    named = groups.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(keys)), F.lit(True).alias(out))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_in_{i}")) for i, c in enumerate(keys)))
    return df.drop(out).join(named, same, "left").drop(*(f"_in_{i}" for i in range(len(keys)))).withColumn(out, F.coalesce(out, F.lit(False)))


def duplicate_entries(df: DataFrame, scope: list[str], raw: str = "raw_value", unit: str = "lab_unit", out: str = "duplicate_entry") -> DataFrame:
    """Whether a row is of a group of ``duplicate_groups``."""
    return in_groups(df, duplicate_groups(df, scope, raw, unit), out)


def unknown_mappings(df: DataFrame) -> DataFrame:
    """Unknown labs, and unknown or missing units of labs that aren't unknown; a null lab isn't."""
    lab, unit = F.coalesce("lab_name_standardized", F.lit("")), F.coalesce("lab_unit_standardized", F.lit(""))
    return df.withColumns({"unknown_lab": lab == UNKNOWN, "unknown_unit": (lab != UNKNOWN) & unit.isin("", UNKNOWN)})


def suspicious_range(df: DataFrame, specs: Specs, out: str = "suspicious_range") -> DataFrame:
    """Bounds the wrong way round, percent above 100, or ten times off what is expected, unless the ``(%)`` sibling fits clearly better."""
    low, high = F.col("reference_min"), F.col("reference_max")
    own = lookup(df, specs.default_ranges(), "lab_name", "lab_name", _low="range_min", _high="range_max")
    own = lookup(own.withColumn("_share", F.concat("lab_name", F.lit(" (%)"))), specs.default_ranges(), "_share", "lab_name", _slow="range_min", _shigh="range_max")
    ratio = lambda a, b: F.when(a.isNotNull() & (b > 0), F.try_divide(a, b))
    ratios = F.filter(F.array(ratio(low, F.col("_low")), ratio(high, F.col("_high"))), lambda x: x.isNotNull())
    off = (F.size(ratios) > 0) & F.forall(ratios, lambda x: (x > 10) | (x < 0.1))
    score = lambda a, b: numeric.range_score(low, high, F.col("value"), F.col(a), F.col(b))
    sibling = _true(score("_low", "_high") - score("_slow", "_shigh") >= 0.25)
    bad = _true(low > high) | _true((F.col("lab_unit") == "%") & (high > 100)) | _true(off & ~sibling)
    return own.withColumn(out, bad).drop("_low", "_high", "_share", "_slow", "_shigh")


def validate(df: DataFrame, specs: Specs, scope: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``review_needed, review_reason`` after all checks on values, in their fixed order; reasons that were there stay in front.

    The rows need ``date, lab_name, value, lab_unit, raw_value, reference_min, reference_max, is_below_limit,
    is_above_limit`` and the ``order`` columns, which identify a row within its scope.
    """
    scope, order = scope or [], order or ["source_file", "page_number", "result_index"]
    for c, t in (("review_needed", "boolean"), ("review_reason", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    duplicates = duplicate_groups(df, scope)
    df = temporal_anomaly(plausibility(df, specs), specs.spec, scope, order)
    df = df.withColumn("_range", range_code(F.col("value"), F.col("reference_min"), F.col("reference_max"))).withColumn("_format", format_artifact(F.col("raw_value"), F.col("value")))
    over = components_over_total(df, scope, order).select(*dict.fromkeys([*scope, *order]), F.lit(True).alias("_over"))
    df = df.join(over, list(dict.fromkeys([*scope, *order])), "left")
    ties = [(r["name"], r["target"], r["formula"], r["tolerance_percent"]) for r in specs.relationship.collect()]  # a few formulas
    off = relationship_mismatches(df, ties, scope, order).select(*scope, "date", F.col("target").alias("lab_name"), F.lit(True).alias("_off")).distinct()
    df = in_groups(df.join(off, [*scope, "date", "lab_name"], "left"), duplicates, "duplicate_entry")
    code = F.col("plausibility_code")
    checks = (
        (code == "NEGATIVE_VALUE", "NEGATIVE_VALUE"), (code == "PERCENTAGE_BOUNDS", "PERCENTAGE_BOUNDS"), (code == "IMPOSSIBLE_VALUE", "IMPOSSIBLE_VALUE"),
        (F.col("_off"), "RELATIONSHIP_MISMATCH"), (F.col("_over"), "COMPONENT_EXCEEDS_TOTAL"), (F.col("temporal_anomaly"), "TEMPORAL_ANOMALY"),
        (F.col("_format"), "FORMAT_ARTIFACT"), (F.col("_range") == "RANGE_INCONSISTENCY", "RANGE_INCONSISTENCY"),
        (F.col("_range") == "EXTREME_DEVIATION", "EXTREME_DEVIATION"), (F.col("duplicate_entry"), "DUPLICATE_ENTRY"),
    )
    flagged = _true(F.col("review_needed"))
    for when, _ in checks:
        flagged = flagged | _true(when)
    reason = T.append_reasons(F.col("review_reason"), list(checks))
    return df.withColumns({"review_reason": reason, "review_needed": flagged}).drop("plausibility_code", "temporal_anomaly", "duplicate_entry", "_range", "_format", "_over", "_off")
