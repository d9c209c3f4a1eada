"""Values and units in primary form. The steps run in the order of ``normalize``; later ones read what earlier ones wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.functions import numeric, text as T
from assayflow.operators.specs import QUALITATIVE, Specs, lookup

# ---- fixed values -------------------------------------------------------------------------------
#: Labs with a qualitative sibling that worded results belong to.
QUALITATIVE_LABS = (
    "Blood - Anti-Tissue Transglutaminase Antibody IgA (Anti-tTG IgA)", "Urine Type II - Blood", "Urine Type II - Bilirubin",
    "Urine Type II - Glucose", "Urine Type II - Ketones", "Urine Type II - Proteins", "Urine Type II - Urobilinogen",
)
#: Sediment counts by field of view, and those of them that also have an absolute sibling.
FIELD_LABS = (
    "Urine Type II - Sediment - Crystals", "Urine Type II - Sediment - Epithelial Cells", "Urine Type II - Sediment - Erythrocytes",
    "Urine Type II - Sediment - Leukocytes", "Urine Type II - Sediment - Small Round Cells",
    "Urine Type II - Sediment - Transitional epithelial cells", "Urine Type II - Sediment - Tubular epithelial cells",
)
ABSOLUTE_LABS = FIELD_LABS[:5]
# -------------------------------------------------------------------------------------------------


def _lab() -> Column:
    return F.col("lab_name_standardized")


def _unit() -> Column:
    return F.col("lab_unit_standardized")


def _default(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def preprocess_values(df: DataFrame) -> DataFrame:
    """``value_primary, is_below_limit, is_above_limit`` from ``raw_value``."""
    return numeric.with_parsed(df, "raw_value")


def field_style_units(df: DataFrame) -> DataFrame:
    """Sediment labs by the microlitre that are really by field: the value says so, or is a word."""
    worded = F.col("raw_value").isNotNull() & F.col("value_primary").isNull()
    by_field = F.coalesce(F.col("raw_value").rlike(r"(?i)/\s*(?:campo|field)\b"), F.lit(False)) | worded
    section = T.is_sediment_section(F.col("raw_section_name"))
    wrong = _lab().isin(*FIELD_LABS) & F.lower(_unit()).isin("/ul", "/µl") & by_field & section
    return df.withColumn("lab_unit_standardized", F.when(F.coalesce(wrong, F.lit(False)), "/campo").otherwise(_unit()))


def absolute_sediment(df: DataFrame, specs: Specs) -> DataFrame:
    """What is still by the microlitre goes to the absolute sibling and its unit, if specified."""
    named = df.withColumn("_sibling", F.when(_lab().isin(*ABSOLUTE_LABS) & F.lower(_unit()).isin("/ul", "/µl", "/μl"), F.concat(_lab(), F.lit(" (Absolute)"))))
    found = lookup(named, specs.spec, "_sibling", "lab_name", _name="lab_name", _unit="primary_unit")
    return found.withColumns({"lab_name_standardized": F.coalesce("_name", _lab()), "lab_unit_standardized": F.when(F.col("_name").isNotNull(), F.coalesce("_unit", _unit())).otherwise(_unit())}).drop("_sibling", "_name", "_unit")


def _to_qualitative(df: DataFrame, when: Column, value: Column) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({
        "value_primary": F.when(hit, value.cast("double")).otherwise(F.col("value_primary")),
        "lab_unit_standardized": F.when(hit, "boolean").otherwise(_unit()),
        "lab_name_standardized": F.when(hit, F.concat(_lab(), F.lit(QUALITATIVE))).otherwise(_lab()),
    })


def qualitative_rows(df: DataFrame, specs: Specs) -> DataFrame:
    """Worded results of these labs go to the qualitative sibling; comments speak only where there is no value."""
    known = lookup(df.withColumn("_q", F.when(_lab().isin(*QUALITATIVE_LABS), F.concat(_lab(), F.lit(QUALITATIVE)))), specs.aliases(), "_q", "alias", _spec="lab_name")
    word = F.when(F.col("raw_value").isNotNull(), T.classify_qualitative(F.col("raw_value"))).otherwise(T.classify_qualitative(F.col("raw_comments")))
    marked = known.withColumn("_word", word)
    return _to_qualitative(marked, F.col("_spec").isNotNull() & F.col("value_primary").isNull() & F.col("_word").isNotNull(), F.col("_word")).drop("_q", "_spec", "_word")


def strip_values(df: DataFrame, specs: Specs) -> DataFrame:
    """Numbers of these labs in a strip section are absent or present."""
    known = lookup(df.withColumn("_q", F.when(_lab().isin(*QUALITATIVE_LABS), F.concat(_lab(), F.lit(QUALITATIVE)))), specs.aliases(), "_q", "alias", _spec="lab_name")
    hit = F.col("_spec").isNotNull() & F.col("value_primary").isNotNull() & T.is_strip_section(F.col("raw_section_name"))
    return _to_qualitative(known, hit, F.when(F.col("value_primary") <= 0, 0).otherwise(1)).drop("_q", "_spec")


def qualitative_values(df: DataFrame, specs: Specs) -> DataFrame:
    """Words as 0 or 1. Of boolean labs: from the value, then comments, which override even numbers; of others only absence is a number."""
    known = lookup(df, specs.aliases(), "lab_name_standardized", "alias", _spec="lab_name")
    known = lookup(known, specs.spec, "_spec", "lab_name", _primary="primary_unit")
    boolean = F.coalesce((F.col("_primary") == "boolean") | (_unit() == "boolean"), F.lit(False))
    value, comment = T.classify_qualitative(F.col("raw_value")), T.classify_qualitative(F.col("raw_comments"))
    number = F.col("value_primary")
    out = F.when(boolean, F.coalesce(comment.cast("double"), number, value.cast("double"))).otherwise(F.when(number.isNull() & (F.coalesce(value, comment) == 0), 0.0).otherwise(number))
    return known.withColumn("value_primary", out).drop("_spec", "_primary")


def convert_units(df: DataFrame, specs: Specs) -> DataFrame:
    """Value and bounds times the factor of the unit, and the primary unit; without a factor all stay as they are."""
    known = lookup(df, specs.aliases(), "lab_name_standardized", "alias", _spec="lab_name")
    known = lookup(known, specs.spec, "_spec", "lab_name", _primary="primary_unit")
    f = specs.factors().select(F.col("lab_name").alias("_lab"), F.col("unit").alias("_unit"), "factor")
    joined = known.join(f, (F.col("_spec") == F.col("_lab")) & (_unit() == F.col("_unit")), "left")
    by = F.coalesce("factor", F.lit(1.0))
    return joined.withColumns({
        "value_primary": F.col("value_primary") * by,
        "reference_min_primary": F.col("raw_reference_min").cast("double") * by,
        "reference_max_primary": F.col("raw_reference_max").cast("double") * by,
        "lab_unit_primary": F.when(F.col("factor").isNotNull(), F.col("_primary")).otherwise(_unit()),
    }).drop("_spec", "_primary", "_lab", "_unit", "factor")


def normalize(df: DataFrame, specs: Specs) -> DataFrame:
    """All steps. The lab type is that of the name before any step renames it; unknown labs count as blood."""
    df = _default(df, raw_section_name="string", raw_comments="string", raw_reference_min="double", raw_reference_max="double")
    df = lookup(df, specs.aliases(), "lab_name_standardized", "alias", _spec="lab_name")
    df = lookup(df, specs.spec, "_spec", "lab_name", lab_type="lab_type").drop("_spec")
    df = preprocess_values(df.withColumn("lab_type", F.coalesce("lab_type", F.lit("blood"))))
    df = absolute_sediment(field_style_units(df), specs)
    df = strip_values(qualitative_rows(df, specs), specs)
    return convert_units(qualitative_values(df, specs), specs)
