"""Raw names and units to standard ones, by caches that are tables, and siblings of a lab by unit and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayflow.functions import numeric, text as T
from assayflow.functions.text import UNKNOWN
from assayflow.operators.specs import IMPLIED_UNITS, PERCENT, QUALITATIVE, Specs, lookup

# ---- fixed values: labels of a urine page and the section that each is printed under ---------------
URINE_SECTIONS = {
    "cor": "< TIPO II >", "ph": "< TIPO II >", "densidade a 15o c": "< TIPO II >", "proteinas": "Elementos anormais",
    "glicose": "Elementos anormais", "corpos cetonicos": "Elementos anormais", "bilirrubina": "Elementos anormais",
    "nitritos": "Elementos anormais", "sangue": "Elementos anormais", "urobilinogenio": "Elementos anormais",
    "celulas epiteliais": "EXAME MICROSCOPICO DO SEDIMENTO", "leucocitos": "EXAME MICROSCOPICO DO SEDIMENTO",
    "eritrocitos": "EXAME MICROSCOPICO DO SEDIMENTO",
}
#: A placeholder, the labs that it may stand for, and their unit.
COMPLEMENT = ("Blood - Complement CH50", ("Blood - Complement C3", "Blood - Complement C4"), "mg/dL")
# ---------------------------------------------------------------------------------------------------
#: Labels of a urine page that a page must have before blank sections are filled, and by how much a sibling's range must fit better.
CONTEXT_ROWS, MARGIN = 3, 0.25


def folded_index(cache: DataFrame, key: str = "key", value: str = "lab_name") -> DataFrame:
    """``folded, value``: folded keys whose entries agree."""
    return cache.groupBy(T.folded_key(F.col(key)).alias("folded")).agg(F.min(value).alias("value"), F.max(value).alias("_max")).filter("value = _max").drop("_max")


def safe_bare_names(cache: DataFrame, key: str = "key", value: str = "lab_name") -> DataFrame:
    """``name, value``: bare names that no entry with a section gives another value."""
    k = F.col(key)
    parts = cache.select(
        F.when(k.contains("|"), F.split_part(k, F.lit("|"), F.lit(1))).when(k.contains(" - "), F.regexp_extract(k, r"^.*? - (.*)$", 1)).alias("in_context"),
        k.alias("_key"), F.col(value).alias("value"),
    )
    bare = parts.filter(~F.col("_key").contains("|")).select(F.col("_key").alias("name"), "value")
    contexts = parts.filter("in_context is not null").groupBy(F.col("in_context").alias("name")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    return bare.join(contexts, "name", "left").filter("_low is null or (_low = value and _high = value)").select("name", "value")


def standardize_names(contexts: DataFrame, cache: DataFrame, name: str = "raw_lab_name", section: str = "raw_section_name", out: str = "lab_name_standardized") -> DataFrame:
    """Each name in its section by the cache: exact keys, folded keys, then the bare name where that is safe; else unknown.

    The caches are the short side of every join, so rows aren't shuffled while the caches are small.
    """
    n, s = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(section), F.lit(""))
    keys = contexts.withColumns({"_exact": T.cache_key(n, s), "_legacy": T.legacy_cache_key(n, s), "_bare": T.name_key(n)})
    keys = keys.withColumns({"_exact_f": T.folded_key(F.col("_exact")), "_legacy_f": T.folded_key(F.col("_legacy")), "_bare_f": T.folded_key(F.col("_bare"))})
    folded, bare = folded_index(cache), safe_bare_names(cache)
    bare_folded = folded_index(bare, "name", "value")
    for i, (key, table, on, value) in enumerate((
        ("_exact", cache, "key", "lab_name"), ("_legacy", cache, "key", "lab_name"), ("_exact_f", folded, "folded", "value"),
        ("_legacy_f", folded, "folded", "value"), ("_bare", bare, "name", "value"), ("_bare_f", bare_folded, "folded", "value"),
    )):
        keys = lookup(keys, table, key, on, **{f"_v{i}": value})
    found = F.coalesce(*(F.col(f"_v{i}") for i in range(6)), F.lit(UNKNOWN))
    return keys.withColumn(out, found).drop("_exact", "_legacy", "_bare", "_exact_f", "_legacy_f", "_bare_f", *(f"_v{i}" for i in range(6)))


def standardize_units(rows: DataFrame, cache: DataFrame, unit: str = "raw_lab_unit", lab: str = "lab_name_standardized", out: str = "lab_unit_standardized") -> DataFrame:
    """Each unit of a lab by the cache ``key, unit``; unknown without an entry, and null without a lab."""
    key = F.concat(T.unit_key(F.coalesce(F.col(unit), F.lit(""))), F.lit("|"), F.lower(F.col(lab)))
    known = (F.coalesce(F.col(lab), F.lit("")) != "") & (F.col(lab) != UNKNOWN)
    joined = lookup(rows.withColumn("_key", key), cache, "_key", "key", _unit="unit")
    return joined.withColumn(out, F.when(known, F.coalesce("_unit", F.lit(UNKNOWN)))).drop("_key", "_unit")


def uncached(rows: DataFrame, cache: DataFrame, key: Column, order: str, keep: list[str]) -> DataFrame:
    """The first row of each key that the cache lacks, in the given order."""
    first = Window.partitionBy("_key").orderBy(order)
    missing = rows.withColumn("_key", key).join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    return missing.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keep)


def backfill_sections(rows: DataFrame, document: str = "source_file", page: str = "page_number", name: str = "raw_lab_name", section: str = "raw_section_name") -> DataFrame:
    """Blank sections of known labels on urine pages: those with at least three of them."""
    table = F.create_map(*(F.lit(x) for kv in URINE_SECTIONS.items() for x in kv))
    known = F.try_element_at(table, T.section_inference_key(F.col(name)))
    marked = rows.withColumn("_section", known)
    n = F.count("_section").over(Window.partitionBy(document, page))
    return marked.withColumn(section, F.when((n >= CONTEXT_ROWS) & (F.trim(F.coalesce(F.col(section), F.lit(""))) == ""), F.coalesce("_section", F.col(section))).otherwise(F.col(section))).drop("_section")


def companion_names(rows: DataFrame, keys: list[str], value: str = "raw_value", unit: str = "raw_lab_unit", name: str = "raw_lab_name") -> DataFrame:
    """``lookup_name``: where a test stands on a page both as a number and as a word, which of the two a row is."""
    no_unit = F.trim(F.coalesce(F.col(unit), F.lit(""))) == ""
    worded = no_unit & T.classify_qualitative(F.col(value)).isNotNull()
    parsed = numeric.with_parsed(rows, value, "_number", "_below", "_above")
    counted = ~no_unit | F.col("_number").isNotNull()
    marked = parsed.withColumns({"_q": F.coalesce(worded, F.lit(False)), "_c": F.coalesce(counted, F.lit(False))})
    group = Window.partitionBy(*keys)
    both = F.max("_q").over(group) & F.max("_c").over(group)
    out = F.when(both & F.col("_q"), F.concat(F.col(name), F.lit(" (qualitative)"))).when(both & F.col("_c"), F.concat(F.col(name), F.lit(" (quantitative)"))).otherwise(F.col(name))
    return marked.withColumn("lookup_name", out).drop("_q", "_c", "_number", "_below", "_above")


def remap_percent_siblings(rows: DataFrame, specs: Specs, lab: str = "lab_name", unit: str = "unit") -> DataFrame:
    """A unit of percent puts a lab on its ``(%)`` sibling, and any other unit on the one without, where there are both."""
    pairs = specs.siblings()
    up = lookup(rows, pairs, lab, "lab_name", _share="percent_name")
    both = lookup(up, pairs, lab, "percent_name", _count="lab_name")
    share = T.unit_looks_percent(F.col(unit))
    blank = F.trim(F.coalesce(F.col(unit), F.lit(""))).isin("", UNKNOWN)
    name = F.when(blank, F.col(lab)).when(share, F.coalesce("_share", F.col(lab))).otherwise(F.coalesce("_count", F.col(lab)))
    return both.withColumn(lab, name).drop("_share", "_count")


def best_candidate(rows: DataFrame, candidates: DataFrame, keys: list[str], raw_min: str, raw_max: str, value: str, margin: float = MARGIN) -> DataFrame:
    """The candidate whose range fits a row best, if the next one is worse by the margin: ``keys, best_name, best_score``.

    ``candidates`` has ``cand, cand_min, cand_max`` for each row's keys. A single candidate needs no margin.
    """
    score = numeric.range_score(F.col(raw_min), F.col(raw_max), F.col(value), F.col("cand_min"), F.col("cand_max"))
    ranked = rows.join(candidates, keys).withColumn("_score", score).filter("_score is not null")
    order = Window.partitionBy(*keys).orderBy("_score", "cand")
    ranked = ranked.withColumns({"_n": F.row_number().over(order), "_next": F.lead("_score").over(order)}).filter("_n = 1")
    return ranked.filter(F.col("_next").isNull() | (F.col("_next") - F.col("_score") >= margin)).select(*keys, F.col("cand").alias("best_name"), F.col("_score").alias("best_score"))


def implied_units(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", unit: str = "lab_unit_standardized") -> DataFrame:
    """The primary unit for blank raw units that are still unknown, where the lab implies one."""
    joined = lookup(lookup(rows, specs.aliases(), lab, "alias", _spec="lab_name"), specs.spec, "_spec", "lab_name", _primary="primary_unit")
    implied = F.col("_primary").isin(*IMPLIED_UNITS) | ((F.col("_primary") == "%") & F.col(lab).endswith(PERCENT.strip()))
    blank = F.trim(F.coalesce(F.col(raw_unit), F.lit(""))) == ""
    return joined.withColumn(unit, F.when(blank & (F.col(unit) == UNKNOWN) & implied, F.col("_primary")).otherwise(F.col(unit))).drop("_spec", "_primary")


def _printed(raw_unit: str) -> Column:
    return F.trim(F.coalesce(F.col(raw_unit), F.lit("")))


def conversion_unit(rows: DataFrame, specs: Specs, lab: str, raw_unit: str, out: str) -> DataFrame:
    """``out``: the unit of the lab's own table, primary first, that a printed one says in other signs; null if none."""
    table = specs.unit_tokens().select(F.col("lab_name").alias("_lab"), F.col("token").alias("_token"), F.col("unit").alias(out))
    keyed = rows.withColumn("_t", T.conversion_unit_token(_printed(raw_unit)))
    return keyed.join(table, (keyed[lab] == F.col("_lab")) & (keyed["_t"] == F.col("_token")) & (keyed["_t"] != ""), "left").drop("_t", "_lab", "_token")


def with_siblings(rows: DataFrame, specs: Specs, lab: str) -> DataFrame:
    """``_share, _count``: the ``(%)`` sibling of a lab, and the lab that a ``(%)`` one is the share of."""
    pairs = specs.siblings()
    return lookup(lookup(rows, pairs, lab, "lab_name", _share="percent_name"), pairs, lab, "percent_name", _count="lab_name")


def effective_labs(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", out: str = "effective_lab") -> DataFrame:
    """The sibling whose units a printed unit is one of: a percent sign, or else a unit or count of the one without."""
    rows = with_siblings(rows, specs, lab).withColumn("_absolute", F.coalesce("_count", F.col(lab)))
    rows = conversion_unit(rows, specs, "_absolute", raw_unit, "_own")
    unit, none = _printed(raw_unit), F.col("_share").isNull() & F.col("_count").isNull()
    counted = F.col("_own").isNotNull() | T.unit_looks_absolute(unit)
    name = F.when((unit == "") | none, F.col(lab)).when(T.unit_looks_percent(unit), F.coalesce("_share", F.col(lab))).when(counted, F.col("_absolute")).otherwise(F.col(lab))
    return rows.withColumn(out, name).drop("_share", "_count", "_absolute", "_own")


def explicit_units(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", unit: str = "lab_unit_standardized") -> DataFrame:
    """A printed unit that the lab's own table has is kept over what a cache says."""
    return conversion_unit(rows, specs, lab, raw_unit, "_unit").withColumn(unit, F.coalesce("_unit", F.col(unit))).drop("_unit")


def variant_units(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", unit: str = "lab_unit_standardized") -> DataFrame:
    """Of a lab with a sibling, a printed percent sign is percent, and anything else printed a unit of the one without: its own, or its primary one."""
    rows = with_siblings(rows, specs, lab).withColumn("_absolute", F.coalesce("_count", F.col(lab)))
    rows = lookup(conversion_unit(rows, specs, "_absolute", raw_unit, "_own"), specs.spec, "_absolute", "lab_name", _primary="primary_unit")
    printed = (_printed(raw_unit) != "") & (F.col("_share").isNotNull() | F.col("_count").isNotNull())
    said = F.when(T.unit_looks_percent(F.col(raw_unit)), F.lit("%")).otherwise(F.coalesce("_own", "_primary"))
    return rows.withColumn(unit, F.when(printed, F.coalesce(said, F.col(unit))).otherwise(F.col(unit))).drop("_share", "_count", "_absolute", "_own", "_primary")


def missing_units(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", value: str = "raw_value", unit: str = "lab_unit_standardized") -> DataFrame:
    """A blank unit becomes the primary one of the lab or its sibling, whichever range fits the printed bounds better by the margin."""
    rows = with_siblings(rows, specs, lab).withColumn("_sibling", F.coalesce("_share", "_count"))
    for name, key in (("a", lab), ("b", "_sibling")):
        rows = lookup(rows, specs.default_ranges(), key, "lab_name", **{f"_{name}_min": "range_min", f"_{name}_max": "range_max"})
        rows = lookup(rows, specs.spec, key, "lab_name", **{f"_{name}_unit": "primary_unit"})
    number = numeric.safe_double(F.replace(F.trim(F.col(value)), F.lit(","), F.lit(".")))
    a, b = (numeric.range_score(F.col("raw_reference_min"), F.col("raw_reference_max"), number, F.col(f"_{n}_min"), F.col(f"_{n}_max")) for n in "ab")
    found = F.when(b - a >= MARGIN, F.col("_a_unit")).when(a - b >= MARGIN, F.col("_b_unit"))
    filled = F.when(_printed(raw_unit) == "", F.coalesce(found, F.col(unit))).otherwise(F.col(unit))
    return rows.withColumn(unit, filled).drop("_share", "_count", "_sibling", *(f"_{n}_{c}" for n in "ab" for c in ("min", "max", "unit")))


def complement_variants(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", value: str = "raw_value", unit: str = "lab_unit_standardized") -> DataFrame:
    """Rows of the complement placeholder in its parts' unit go to the part whose range fits better by the margin; a single one that compares needs none."""
    whole, parts, of = COMPLEMENT
    number = numeric.safe_double(F.replace(F.trim(F.col(value)), F.lit(","), F.lit(".")))
    scores = []
    for i, part in enumerate(parts):
        rows = lookup(rows.withColumn("_part", F.lit(part)), specs.default_ranges(), "_part", "lab_name", **{f"_{i}_min": "range_min", f"_{i}_max": "range_max"})
        rows = lookup(rows, specs.spec, "_part", "lab_name", **{f"_{i}_unit": "primary_unit"})
        scores.append(numeric.range_score(F.col("raw_reference_min"), F.col("raw_reference_max"), number, F.col(f"_{i}_min"), F.col(f"_{i}_max")))
    a, b = scores
    first, second = b.isNull() & a.isNotNull() | (b - a >= MARGIN), a.isNull() & b.isNotNull() | (a - b >= MARGIN)
    here = (F.col(lab) == whole) & (T.conversion_unit_token(_printed(raw_unit)) == T.conversion_unit_token(F.lit(of)))
    pick = F.when(here & first, 0).when(here & second, 1)
    out = rows.withColumn("_pick", pick)
    named = F.when(F.col("_pick") == 0, parts[0]).when(F.col("_pick") == 1, parts[1]).otherwise(F.col(lab))
    given = F.when(F.col("_pick") == 0, F.col("_0_unit")).when(F.col("_pick") == 1, F.col("_1_unit")).otherwise(F.col(unit))
    return out.withColumns({lab: named, unit: given}).drop("_part", "_pick", *(f"_{i}_{c}" for i in (0, 1) for c in ("min", "max", "unit")))


def qualitative_aliases(rows: DataFrame, specs: Specs, lab: str = "lab_name_standardized", raw_unit: str = "raw_lab_unit", value: str = "raw_value") -> DataFrame:
    """Worded rows of a boolean lab go by its qualitative name; rows with a printed unit leave it for the base analyte."""
    spec = specs.spec
    joined = lookup(rows, spec, lab, "lab_name", _primary="primary_unit")
    base = F.regexp_replace(F.col(lab), r" \(Qualitative\)$", "")
    joined = lookup(joined.withColumn("_base", base), spec, "_base", "lab_name", _there="lab_name")
    blank = F.trim(F.coalesce(F.col(raw_unit), F.lit(""))) == ""
    worded = blank & (F.col("_primary") == "boolean") & T.classify_qualitative(F.col(value)).isNotNull() & ~F.col(lab).endswith(QUALITATIVE)
    leave = ~blank & F.col(lab).endswith(QUALITATIVE) & F.col("_there").isNotNull()
    name = F.when(worded, F.concat(F.col(lab), F.lit(QUALITATIVE))).when(leave, F.col("_base")).otherwise(F.col(lab))
    return joined.withColumn(lab, name).drop("_primary", "_base", "_there")


def standardize(rows: DataFrame, specs: Specs, name_cache: DataFrame, unit_cache: DataFrame, companion_keys: list[str] | None = None) -> DataFrame:
    """Names and units of review rows. Later rules win: units by cache, as printed, by variant, by range, as implied; then names follow units."""
    keys = companion_keys or ["source_file", "page_number", "raw_lab_name", "raw_section_name"]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("raw_reference_min", "raw_reference_max") if c not in rows.columns})
    rows = companion_names(rows, keys)
    rows = standardize_names(rows, name_cache, "lookup_name", out="_by_lookup")
    rows = standardize_names(rows, name_cache, out="_by_name")
    rows = rows.withColumn("lab_name_standardized", F.when(F.col("_by_lookup") == UNKNOWN, F.col("_by_name")).otherwise(F.col("_by_lookup"))).drop("_by_lookup", "_by_name", "lookup_name")
    rows = qualitative_aliases(rows, specs)
    rows = standardize_units(effective_labs(rows, specs), unit_cache, lab="effective_lab")
    rows = variant_units(explicit_units(rows, specs, "effective_lab"), specs, "effective_lab")
    rows = implied_units(missing_units(rows, specs, "effective_lab"), specs, "effective_lab").drop("effective_lab")
    rows = remap_percent_siblings(rows, specs, "lab_name_standardized", "lab_unit_standardized")
    return complement_variants(rows, specs)
