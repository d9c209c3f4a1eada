"""Checks of a published table: each breach is a row of ``check, row_key``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assayflow.operators.dedup import repeated_keys, repeated_rows

# ---- fixed values: shares that may be above 100 ----------------------------------------------------
PERCENT_EXCEPTIONS = ("Blood - Prothrombin Time (PT) (%)",)
# ----------------------------------------------------------------------------------------------------


def unit_inconsistency(df: DataFrame, lab: str = "lab_name", unit: str = "lab_unit") -> DataFrame:
    """``lab, n_units`` of labs in more than one unit."""
    return df.filter(F.col(lab).isNotNull()).groupBy(lab).agg(F.count_distinct(unit).alias("n_units")).filter("n_units > 1")


def outliers(df: DataFrame, lab: str = "lab_name", unit: str = "lab_unit", value: str = "value", least: int = 5, sigmas: float = 3) -> DataFrame:
    """Values beyond three sample deviations from the mean of their lab in its most frequent unit, of five values or more.

    Statistics are aggregated by lab and unit first, so a frequent lab is a partial sum in each task, and then joined.
    """
    rows = df.filter(F.col(lab).isNotNull() & F.col(unit).isNotNull())
    stats = rows.groupBy(lab, unit).agg(F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    top = Window.partitionBy(lab).orderBy(F.desc("_rows"), unit)
    stats = stats.withColumn("_k", F.row_number().over(top)).filter((F.col("_k") == 1) & (F.col("_n") >= least) & (F.col("_sd") != 0))
    return rows.join(stats, [lab, unit]).filter(F.abs(F.col(value) - F.col("_mean")) > sigmas * F.col("_sd")).drop("_rows", "_n", "_mean", "_sd", "_k")


def integrity_violations(df: DataFrame, key: str) -> DataFrame:
    """All checks of dates, repeats, units and values. What a row tells by itself is found in one pass."""
    v, unit, lab = F.col("value"), F.col("lab_unit"), F.col("lab_name")
    own = {
        "no date": F.col("date").isNull(),
        "percent without (%)": (unit == "%") & ~lab.endswith("(%)"),
        "percent out of bounds": (unit == "%") & ((v < 0) | ((v > 100) & ~lab.isin(*PERCENT_EXCEPTIONS))),
        "boolean not 0 or 1": (unit == "boolean") & (v.isNull() | ~v.isin(0.0, 1.0)),
    }
    several = {
        "repeated row": repeated_rows(df, [c for c in df.columns if c != key]),
        "repeated date and lab": repeated_keys(df, ["date", "lab_name"]),
        "inconsistent unit": df.join(unit_inconsistency(df), "lab_name", "left_semi"),
        "outlier": outliers(df),
    }
    out = df.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(check)) for check, bad in own.items())))).alias("check"), F.col(key).alias("row_key"))
    for check, rows in several.items():
        out = out.unionByName(rows.select(F.lit(check).alias("check"), F.col(key).alias("row_key")))
    return out
