"""What the results explorer shows: filters, orders, cards, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayflow.functions import numeric, text as T
from assayflow.operators.dedup import latest_only
from assayflow.operators.review import count_if


def _set(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def pill(name: str, status: str = "review_status") -> Column:
    """The rows behind a filter pill."""
    s, open_ = T.persisted_status(F.col(status)), F.trim(F.coalesce(F.col(status), F.lit(""))) == ""
    return {
        "All": F.lit(True), "Unreviewed": open_, "Abnormal": _set("is_out_of_reference"), "Needs Review": _set("review_needed") & open_,
        "Suboptimal": _set("is_out_of_optimal_range"), "Unhealthy": _set("is_out_of_optimal_range"),
        "Accepted": F.coalesce(s == "accepted", F.lit(False)), "Rejected": F.coalesce(s == "rejected", F.lit(False)),
    }[name]


def explore(df: DataFrame, order: list[str], labs: list[str] | None = None, latest: bool = False, review: str = "All", document: str | None = None) -> DataFrame:
    """Filters in this order: document, latest of each lab, lab, pill."""
    if document:
        df = df.filter(F.col("source_file") == document)
    if latest:
        df = latest_only(df, order)
    if labs:
        df = df.filter(F.col("lab_name").isin(*labs))
    return df.filter(pill(review))


PILLS = ("All", "Unreviewed", "Abnormal", "Needs Review", "Suboptimal", "Unhealthy", "Accepted", "Rejected")


def pill_counts(df: DataFrame, order: list[str], pills: tuple[str, ...] = PILLS) -> DataFrame:
    """``pill, latest, n``: how many rows each filter leaves, of all rows and of the latest of each lab. One pass for each of the two."""
    counts = F.array(*(F.struct(F.lit(p).alias("pill"), F.count_if(pill(p)).alias("n")) for p in pills))
    one = lambda rows, latest: rows.agg(counts.alias("c")).select(F.inline("c")).select("pill", F.lit(latest).alias("latest"), "n")
    return one(df, False).union(one(latest_only(df, order), True))


def sort_keys(document: bool = False, newest: bool = True) -> list[Column]:
    place = [F.col(c).asc_nulls_last() for c in ("page_number", "result_index", "lab_name")]
    if document:
        return place
    return [F.col("date").desc_nulls_last() if newest else F.col("date").asc_nulls_last(), F.col("source_file").asc_nulls_last(), *place]


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By a column, then as before. Missing text sorts as empty text; other missing values come last either way."""
    textual = dict(df.dtypes)[column] == "string"
    key = F.lower(F.coalesce(F.col(column), F.lit(""))) if textual else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *sort_keys())


def summary_cards(df: DataFrame) -> DataFrame:
    s = T.persisted_status(F.col("review_status"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lab_name").alias("n_labs"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"),
        count_if(_set("is_out_of_reference")).alias("n_abnormal"), count_if(_set("is_out_of_optimal_range")).alias("n_suboptimal"), count_if(s.isNotNull()).alias("n_reviewed"),
        count_if(s == "accepted").alias("n_accepted"), count_if(s == "rejected").alias("n_rejected"), count_if(_set("review_needed")).alias("n_needs_review"),
    )


def lab_choices(df: DataFrame) -> DataFrame:
    return df.select("lab_name").distinct().filter("trim(lab_name) <> '' and not startswith(lab_name, '$UNKNOWN')").orderBy("lab_name")


# ---- fixed values: what the table shows, in order, and its headings --------------------------------
DISPLAY = {
    "date": "Date", "lab_name": "Mapped Lab", "value": "Mapped Value", "lab_unit": "Mapped Unit", "reference_range": "Mapped Range", "review_status": "Review Status",
    "raw_value": "Raw Value", "raw_lab_unit": "Raw Unit", "raw_reference_range": "Raw Range", "source_document": "Document", "page_number": "Page",
}
# -----------------------------------------------------------------------------------------------------


def visible_columns(wanted: list[str] | None = None) -> list[str]:
    """The wanted columns in the table's order; all by default, and the first where none is known."""
    if wanted is None:
        return list(DISPLAY)
    return [c for c in DISPLAY if c in set(wanted)] or list(DISPLAY)[:1]


def display(df: DataFrame, wanted: list[str] | None = None, labels: bool = True) -> DataFrame:
    """The table's columns as text a person reads: values rounded half to even at two places, dates and pages as text, the status with a capital. Missing columns are blank."""
    made = {
        "date": lambda: F.date_format("date", "yyyy-MM-dd"), "value": lambda: F.bround("value", 2), "page_number": lambda: F.coalesce(F.col("page_number").cast("bigint").cast("string"), F.lit("")),
        "review_status": lambda: F.initcap(F.coalesce("review_status", F.lit(""))),
    }
    if "reference_range" not in df.columns and {"reference_min", "reference_max"} <= set(df.columns):
        df = df.withColumn("reference_range", numeric.range_text(F.col("reference_min"), F.col("reference_max")))
    if "source_document" not in df.columns and "source_file" in df.columns:
        df = df.withColumn("source_document", T.document_label(F.col("source_file")))
    shown = ((c, (made[c]() if c in made else F.col(c)) if c in df.columns else F.lit("")) for c in visible_columns(wanted))
    return df.select(*(v.alias(DISPLAY[c] if labels else c) for c, v in shown))


def row_context(view: DataFrame, position: int, lab: str | None = None) -> DataFrame:
    """What stands beside the selected row: ``position_text``, the reference pair (null without bounds), and the lab to plot."""
    total = view.agg(F.count(F.lit(1))).scalar()
    some = F.col("reference_min").isNotNull() | F.col("reference_max").isNotNull()
    return view.filter(F.col("position") == position).select(
        "position", F.format_string("Row %d of %d", (F.col("position") + 1).cast("long"), total).alias("position_text"),
        F.when(some, F.struct(F.col("reference_min").alias("min"), F.col("reference_max").alias("max"))).alias("selected_ref"), (F.lit(lab) if lab else F.col("lab_name")).alias("plot_lab"),
    )


def plot_series(df: DataFrame, lab: str) -> DataFrame:
    """A lab's dated values in order of time, with the first unit that is known."""
    rows = df.filter((F.col("lab_name") == lab) & F.col("date").isNotNull() & F.col("value").isNotNull())
    first = rows.agg(F.min_by("lab_unit", F.when(F.col("lab_unit").isNotNull(), F.struct("date", "lab_unit")))).scalar()
    return rows.withColumn("lab_unit", first).orderBy("date")


def reference_mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of a column for each key, and of several the smallest."""
    return df.groupBy(*keys).agg(F.mode(column, deterministic=True).alias(f"mode_{column}"))
