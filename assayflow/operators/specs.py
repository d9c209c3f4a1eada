"""Lab specifications as dimension tables, their lookups and their rules.

Joins here carry no broadcast hint: the optimizer broadcasts a dimension by its measured size, and shuffles one that has grown.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayflow.functions.text import conversion_unit_token

SPEC = "lab_name string, lab_type string, primary_unit string, loinc_code string, biological_min double, biological_max double, max_daily_change double, ranges_vary_with_cycle boolean"
UNIT_FACTOR = "lab_name string, pos int, unit string, factor double"
SPEC_RANGE = "lab_name string, pos int, key string, min double, max double"
RELATIONSHIP = "name string, target string, formula string, tolerance_percent double"
QUALITATIVE = " (Qualitative)"
PERCENT = " (%)"

# ---- fixed values: lab types and how names of each begin; units that blank text may stand for --------
PREFIXES = {"blood": "Blood - ", "urine": "Urine ", "feces": "Feces - ", "saliva": "Saliva - ", "semen": "Semen - "}
IMPLIED_UNITS = ("boolean", "mm/h", "pH", "unitless")
# -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Specs:
    """Four tables: labs, conversion factors, reference ranges by demographic key, relationships between labs."""

    spec: DataFrame
    unit_factor: DataFrame
    spec_range: DataFrame
    relationship: DataFrame

    @classmethod
    def from_dict(cls, spark: SparkSession, config: dict) -> Specs:
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        labs, factors, ranges = [], [], []
        for name, s in config.items():
            if name.startswith("_"):
                continue
            labs.append((name, s.get("lab_type", "blood"), s.get("primary_unit"), s.get("loinc_code"), number(s.get("biological_min")), number(s.get("biological_max")), number(s.get("max_daily_change")), s.get("ranges_vary_with_cycle")))
            factors += [(name, i, a.get("unit"), number(a.get("factor"))) for i, a in enumerate(s.get("alternatives") or [])]
            ranges += [(name, i, k, number(v[0]), number(v[1])) for i, (k, v) in enumerate((s.get("ranges") or {}).items()) if isinstance(v, list) and len(v) > 1]
        ties = [(r.get("name"), r.get("target"), r.get("formula"), float(r.get("tolerance_percent", 15))) for r in config.get("_relationships", [])]
        make = spark.createDataFrame
        return cls(make(labs, SPEC), make(factors, UNIT_FACTOR), make(ranges, SPEC_RANGE), make(ties, RELATIONSHIP))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Specs:
        """The file is read by Spark, so it may be in any store; specifications are small by nature."""
        text = spark.read.text(path, wholetext=True).first()
        return cls.from_dict(spark, json.loads(text.value) if text else {})

    def aliases(self) -> DataFrame:
        """``alias, lab_name``: every name, and boolean labs also under their qualitative name and without it."""
        own = self.spec.select(F.col("lab_name").alias("alias"), "lab_name", F.lit(0).alias("rank"))
        boolean = self.spec.filter("primary_unit = 'boolean'")
        ends = F.col("lab_name").endswith(QUALITATIVE)
        other = boolean.select(F.when(ends, F.expr(f"substring(lab_name, 1, length(lab_name) - {len(QUALITATIVE)})")).otherwise(F.concat("lab_name", F.lit(QUALITATIVE))).alias("alias"), "lab_name", F.lit(1).alias("rank"))
        first = Window.partitionBy("alias").orderBy("rank", "lab_name")
        return own.union(other).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("alias", "lab_name")

    def factors(self) -> DataFrame:
        """``lab_name, unit, factor``: the primary unit at one, and each other unit at its first factor."""
        primary = self.spec.filter("primary_unit is not null").select("lab_name", F.lit(-1).alias("pos"), F.col("primary_unit").alias("unit"), F.lit(1.0).alias("factor"))
        first = Window.partitionBy("lab_name", "unit").orderBy("pos")
        return primary.union(self.unit_factor).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("lab_name", "unit", "factor")

    def unit_tokens(self) -> DataFrame:
        """``lab_name, token, unit``: units by how they compare, the primary first."""
        rows = self.spec.filter("primary_unit is not null").select("lab_name", F.lit(-1).alias("pos"), F.col("primary_unit").alias("unit")).union(self.unit_factor.select("lab_name", "pos", "unit"))
        rows = rows.withColumn("token", conversion_unit_token(F.col("unit")))
        first = Window.partitionBy("lab_name", "token").orderBy("pos")
        return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("lab_name", "token", "unit")

    def siblings(self) -> DataFrame:
        """``lab_name, percent_name``: labs that are there both as a share and otherwise."""
        share = self.spec.select(F.col("lab_name").alias("percent_name"))
        return self.spec.select("lab_name").join(share, F.concat("lab_name", F.lit(PERCENT)) == F.col("percent_name"))

    def names(self) -> DataFrame:
        return self.spec.select("lab_name").orderBy("lab_name")

    def units(self) -> DataFrame:
        """``unit``: every primary and alternative unit once, sorted."""
        both = self.spec.select(F.col("primary_unit").alias("unit")).union(self.unit_factor.select("unit"))
        return both.filter("trim(unit) <> ''").distinct().orderBy("unit")

    def codes(self) -> DataFrame:
        """``alias, loinc_code`` of every name that a lab goes by and that has a code."""
        return lookup(self.aliases(), self.spec.filter("trim(loinc_code) <> ''"), "lab_name", "lab_name", loinc_code="loinc_code").filter("loinc_code is not null").select("alias", "loinc_code")

    def to_dict(self) -> dict:
        """The configuration that ``from_dict`` reads, labs by name. Specifications are small by nature."""
        out: dict = {r.lab_name: {k: v for k, v in r.asDict().items() if k != "lab_name" and v is not None} for r in self.spec.orderBy("lab_name").collect()}
        for r in self.unit_factor.orderBy("lab_name", "pos").collect():
            out[r.lab_name].setdefault("alternatives", []).append({"unit": r.unit, "factor": r.factor})
        for r in self.spec_range.orderBy("lab_name", "pos").collect():
            out[r.lab_name].setdefault("ranges", {})[r.key] = [r.min, r.max]
        ties = [r.asDict() for r in self.relationship.orderBy("name", "target", "formula").collect()]
        return out | ({"_relationships": ties} if ties else {})

    def default_ranges(self) -> DataFrame:
        return self.spec_range.filter("key = 'default'").select("lab_name", F.col("min").alias("range_min"), F.col("max").alias("range_max"))


def lookup(df: DataFrame, table: DataFrame, key: str, on: str, **columns: str) -> DataFrame:
    """A left join of a dimension's columns, under new names, by one key."""
    side = table.select(F.col(on).alias("_on"), *(F.col(c).alias(n) for n, c in columns.items()))
    return df.join(side, df[key] == side["_on"], "left").drop("_on")


def demographic_ranges(people: DataFrame, spec_range: DataFrame, sex: str = "sex", age: str = "age") -> DataFrame:
    """Each person's range of each lab: the first ``sex:ages`` key that fits, else the sex, else the default.

    Ages are ``a-b``, both ends included, or ``n+``. Keys are few, so the interval join has labs x keys on one side.
    """
    k = F.col("key")
    ages = F.split_part(k, F.lit(":"), F.lit(2))
    low = F.when(ages.endswith("+"), F.regexp_extract(ages, r"^(\d+)\+$", 1)).otherwise(F.regexp_extract(ages, r"^(\d+)-", 1)).try_cast("int")
    high = F.when(ages.endswith("+"), F.lit(1_000)).otherwise(F.regexp_extract(ages, r"-(\d+)$", 1).try_cast("int"))
    keys = spec_range.select(
        "lab_name", F.when(k == "default", None).otherwise(F.split_part(k, F.lit(":"), F.lit(1))).alias("_sex"), low.alias("_low"), high.alias("_high"),
        F.when(k.contains(":"), 0).when(k == "default", 2).otherwise(1).alias("_rank"), "pos", F.col("min").alias("range_min"), F.col("max").alias("range_max"),
    )
    fits = (F.col("_sex").isNull() | (F.col("_sex") == people[sex])) & ((F.col("_rank") != 0) | people[age].between(F.col("_low"), F.col("_high")))
    best = F.min_by(F.struct("range_min", "range_max"), F.struct("_rank", "pos"))
    joined = people.join(keys, fits)
    return joined.groupBy(*people.columns, "lab_name").agg(best.alias("_r")).select(*people.columns, "lab_name", "_r.range_min", "_r.range_max")


def spec_violations(specs: Specs) -> DataFrame:
    """``rule, lab_name``: every breach of the rules for specifications."""
    s, u, r = specs.spec, specs.unit_factor, specs.spec_range

    def broken(rows: DataFrame, rule: str, bad: Column, name: str = "lab_name") -> DataFrame:
        return rows.filter(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(name).alias("lab_name"))

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    prefix = F.lit(False)
    for kind, start in PREFIXES.items():
        prefix = prefix | ((F.col("lab_type") == kind) & ~F.col("lab_name").startswith(start))
    repeated = s.filter(~blank("loinc_code")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("loinc_code")))
    parts = [
        broken(s, "lab_type is required", blank("lab_type")),
        broken(s, "primary_unit is required", blank("primary_unit")),
        broken(s, "loinc_code is required", blank("loinc_code")),
        broken(s, "lab_type is unknown", ~blank("lab_type") & ~F.col("lab_type").isin(*PREFIXES)),
        broken(s, "name and lab_type differ", prefix),
        broken(s, "percent unit without (%) in the name", (F.col("primary_unit") == "%") & ~F.col("lab_name").contains("(%)")),
        broken(s, "loinc_code has no digit", ~blank("loinc_code") & ~F.col("loinc_code").rlike(r"\d")),
        broken(repeated, "loinc_code repeats", F.col("_n") > 1),
        broken(s, "biological limits are not in order", F.col("biological_min") >= F.col("biological_max")),
        broken(s, "max_daily_change is not positive", F.col("max_daily_change") <= 0),
        broken(u, "alternative without a unit", blank("unit")),
        broken(u, "factor is not positive", F.col("factor").isNull() | (F.col("factor") <= 0)),
        broken(r, "range without bounds", F.col("min").isNull() & F.col("max").isNull()),
        broken(r, "range is not in order", F.col("min") > F.col("max")),
        broken(specs.relationship, "relationship without name, target or formula", blank("name") | blank("target") | blank("formula"), "name"),
        broken(specs.relationship, "tolerance is not within 0 to 100", ~F.col("tolerance_percent").between(0, 100), "name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
