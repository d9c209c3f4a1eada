"""Review state: summaries, queues, decisions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayflow.functions import text as T
from assayflow.functions.text import UNKNOWN
from assayflow.operators.positions import global_positions

IDENTITY = ["source_file", "page_number", "result_index"]
# ---- fixed values: the export, in order -----------------------------------------------------------
EXPORT = {
    "date": "date", "lab_name": "string", "value": "double", "lab_unit": "string", "source_file": "string", "page_number": "bigint",
    "reference_min": "double", "reference_max": "double", "raw_lab_name": "string", "review_needed": "boolean", "review_reason": "string",
    "is_below_limit": "boolean", "is_above_limit": "boolean", "lab_type": "string", "result_index": "bigint", "raw_value": "string",
    "raw_unit": "string", "raw_reference_range": "string",
}
# ---------------------------------------------------------------------------------------------------


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def review_counts(status: Column) -> list[Column]:
    s = T.persisted_status(status)
    return [F.count(F.lit(1)).alias("total"), count_if(s == "accepted").alias("accepted"), count_if(s == "rejected").alias("rejected"), count_if(s.isNull()).alias("pending")]


def review_summary(rows: DataFrame, keys: list[str] | None = None, markers: DataFrame | None = None, status: str = "review_status") -> DataFrame:
    """Counts by decision, for each key: ``total, accepted, rejected, pending, markers, reviewed, fixture_ready``.

    A document without pending rows and without markers of missing rows is ready, even an empty one.
    """
    keys = keys or []
    out = rows.groupBy(*keys).agg(*review_counts(F.col(status)))
    if markers is None:
        out = out.withColumn("markers", F.lit(0).cast("long"))
    else:
        out = out.join(markers.groupBy(*keys).agg(F.count(F.lit(1)).alias("markers")), keys, "full")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "accepted", "rejected", "pending", "markers")}
    return out.withColumns(filled).withColumns({"reviewed": F.col("accepted") + F.col("rejected"), "fixture_ready": (F.col("pending") == 0) & (F.col("markers") == 0)})


def reason_counts(rows: DataFrame, reason: str = "review_reason") -> DataFrame:
    """``reason, n`` of every code in every row."""
    return rows.select(F.explode(T.reason_codes(F.col(reason))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def document_summary(rows: DataFrame, has_box: Column, needs_review: Column, status: Column, key: str = "source_file") -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("results"), count_if(has_box).alias("boxes"), count_if(needs_review).alias("needs_review"), count_if(T.persisted_status(status).isNull()).alias("unreviewed")
    )


def queue(rows: DataFrame, show_reviewed: bool = False, status: str = "review_status") -> DataFrame:
    """Pending rows first, then by page and index, with their place in ``position``."""
    pending = T.persisted_status(F.col(status)).isNull()
    kept = rows if show_reviewed else rows.filter(pending)
    order = Window.partitionBy("source_file").orderBy(F.when(pending, 0).otherwise(1), "page_number", "result_index")
    return kept.withColumn("position", F.row_number().over(order) - 1)


def next_pending(rows: DataFrame, current: DataFrame, status: str = "review_status") -> DataFrame:
    """The next pending row of each document after its current one: on the page, then after it, then the first of all."""
    at = current.select("source_file", F.col("page_number").alias("_page"), F.col("result_index").alias("_index"))
    waiting = rows.filter(T.persisted_status(F.col(status)).isNull()).join(at, "source_file")
    page, index = F.col("page_number"), F.col("result_index")
    rank = F.when((page == F.col("_page")) & (index > F.col("_index")), 0).when(page > F.col("_page"), 1).otherwise(2)
    order = Window.partitionBy("source_file").orderBy(rank, page, index)
    return waiting.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_page", "_index")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The state of an append-only log of ``identity, status, decided_at``: the last entry of each row; a cleared one has no status.

    Entries of one time go by ``sequence``, where the log has it, and then by status; an entry without a time comes before all others.
    """
    sequence = F.col("sequence") if "sequence" in decisions.columns else F.lit(0)
    order = F.struct(F.coalesce(F.col("decided_at").cast("string"), F.lit("")), F.coalesce(sequence.cast("long"), F.lit(0)), F.coalesce("status", F.lit("")))
    last = decisions.groupBy(*IDENTITY).agg(F.max_by(F.struct("status", "decided_at"), order).alias("_d"))
    return last.select(*IDENTITY, T.persisted_status(F.col("_d.status")).alias("review_status"), F.col("_d.decided_at").alias("review_completed_at"))


def with_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    return rows.drop("review_status", "review_completed_at").join(latest_decisions(decisions), IDENTITY, "left")


# ---- decisions ----------------------------------------------------------------------------------
# fixed values: what a reviewer may ask for, and the status that it gives; a marker gives none
ACTIONS = {"accept": "accepted", "reject": "rejected", "clear": "", "missing_row": None}
DECISION = "source_file string, page_number long, result_index long, status string, decided_at string"
MISSING = "source_file string, page_number long, anchor_result_index long, created_at string"


class NotReady(ValueError):
    """A document that can't be published yet."""


def review_action(c: Column) -> Column:
    a = F.lower(T.strip(c))
    return F.when(a.isin(*ACTIONS), a)


def whole_number(c: Column) -> Column:
    """A page or index from text or numbers; null if it isn't whole."""
    text = T.strip(c.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")).when(number == F.floor(number), F.floor(number).cast("long"))


def with_identity(rows: DataFrame) -> DataFrame:
    """Source, page and index in their types; all three null where one can't be read. Booleans are no numbers."""
    flags = {c for c, t in rows.dtypes if t == "boolean"}
    source = F.nullif(T.strip(F.col("source_file").cast("string")), F.lit(""))
    page, index = (F.lit(None).cast("long") if c in flags else whole_number(F.col(c)) for c in IDENTITY[1:])
    good = source.isNotNull() & page.isNotNull() & index.isNotNull()
    return rows.withColumns({c: F.when(good, v) for c, v in zip(IDENTITY, (source, page, index))})


def judge_requests(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """``requests(identity, action)`` with ``refused``, the reason why one can't be carried out, or null.

    ``sizes``: ``source_file, page_number, n_results`` of the pages that are there.
    """
    asked = with_identity(requests).withColumn("action", review_action(F.col("action")))
    known = asked.join(sizes.select("source_file", "page_number", "n_results"), ["source_file", "page_number"], "left")
    inside = (F.col("result_index") >= 0) & (F.col("result_index") < F.col("n_results"))
    reason = F.when(F.col("source_file").isNull(), "no row").when(F.col("action").isNull(), "unknown action").when(F.col("n_results").isNull(), "no such page").when(~inside, "out of range")
    return known.withColumn("refused", reason).drop("n_results")


def decisions_of(judged: DataFrame, at: Column) -> DataFrame:
    """Entries for the log of decisions; a cleared one has a blank status."""
    status = F.coalesce(*(F.when(F.col("action") == a, F.lit(s)) for a, s in ACTIONS.items() if s is not None))
    return judged.filter("refused is null and action <> 'missing_row'").select(*IDENTITY, status.alias("status"), at.alias("decided_at"))


def markers_of(judged: DataFrame, at: Column) -> DataFrame:
    """Entries for the log of missing rows, each after an anchor."""
    return judged.filter("refused is null and action = 'missing_row'").select("source_file", "page_number", F.col("result_index").alias("anchor_result_index"), at.alias("created_at"))


def utc_text(at: Column) -> Column:
    """ISO 8601 in UTC, to the microsecond."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def unready(summary: DataFrame, key: str = "source_file") -> DataFrame:
    """``key, issue`` of documents with pending rows or markers of missing rows."""
    pending = F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" pending row(s)")))
    missing = F.when(F.col("markers") > 0, F.concat(F.col("markers").cast("string"), F.lit(" unresolved missing-row marker(s)")))
    return summary.filter(~F.col("fixture_ready")).select(key, F.concat_ws(", ", pending, missing).alias("issue"))


def ensure_ready(summary: DataFrame, key: str = "source_file") -> None:
    """Raises with the first ten documents that aren't ready."""
    found = unready(summary, key).orderBy(key).limit(10).collect()
    if found:
        raise NotReady("; ".join(f"{r[key]}: {r.issue}" for r in found))


# ---- where a reviewer goes ------------------------------------------------------------------------
def next_in_corpus(rows: DataFrame, review_needed_only: bool = False, status: str = "review_status") -> DataFrame:
    """The first pending row by document, page and index, if there is one."""
    pending = T.persisted_status(F.col(status)).isNull()
    if review_needed_only:
        pending = pending & F.coalesce("review_needed", F.lit(False))
    return rows.filter(pending).orderBy(*IDENTITY).limit(1)


def filter_documents(summary: DataFrame, mode: str = "All") -> DataFrame:
    """All documents, those ``Not Fixture Ready``, or with any other mode the ready ones."""
    return summary if mode == "All" else summary.filter(~F.col("fixture_ready") if mode == "Not Fixture Ready" else F.col("fixture_ready"))


def document_choices(summary: DataFrame, key: str = "source_file") -> DataFrame:
    """Documents with a label and their ``place``: those with the most pending rows first, the ready ones last."""
    label = F.format_string("%s (pending %d, rejected %d, missing %d, reviewed %d/%d)", key, "pending", "rejected", "markers", "reviewed", "total")
    order = [F.col("fixture_ready"), F.desc("pending"), F.lower(key), F.col(key)]
    return summary.select(key, label.alias("label"), "fixture_ready", "pending").orderBy(*order)


def document_order(priority: bool) -> list[Column]:
    """Orders of ``document_summary``: most boxes, then doubts, open rows and results first; or by name."""
    counts = [F.desc(c) for c in ("boxes", "needs_review", "unreviewed", "results")] if priority else []
    return [*counts, F.col("source_file").asc_nulls_last()]


def initial_document(summary: DataFrame, priority: bool = True) -> DataFrame:
    """The document to open first; none without priority."""
    return summary.orderBy(*document_order(True)).limit(1 if priority else 0).select("source_file")


def numbered(rows: DataFrame, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """``position`` from zero: within each key of ``by`` (a document), or without one over the whole view, which is then written in order."""
    if not by:
        return global_positions(rows, order)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def select_row(view: DataFrame, position: int | None = None) -> DataFrame:
    """The row at a position of a ``numbered`` view, the first by default; none out of range."""
    return view.filter(F.col("position") == (0 if position is None else position))


def moves(view: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each row of a ``numbered`` view, ``previous`` and ``next`` positions, held at the ends."""
    last = (F.count(F.lit(1)).over(Window.partitionBy(*by)) if by else view.agg(F.count(F.lit(1))).scalar()) - 1
    return view.withColumns({"previous": F.greatest(F.col("position") - 1, F.lit(0)), "next": F.least((F.col("position") + 1).cast("long"), last)})


def resolve_position(view: DataFrame, tokens: list[str], fallback: int = 0) -> DataFrame:
    """``position`` of the first of the tokens that the view still has, or else the fallback held within it; zero if empty."""
    rank = F.array_position(F.array(*map(F.lit, tokens)), F.col("token")) if tokens else F.lit(0).cast("long")
    best = F.min_by("position", F.when(rank > 0, F.struct(rank, "position")))
    return view.agg(F.coalesce(best, F.greatest(F.lit(0), F.least(F.lit(fallback), F.count(F.lit(1)) - 1))).cast("long").alias("position"))


def queue_display(queued: DataFrame, current: int | None = None, status: str = "review_status") -> DataFrame:
    """What the queue shows: a mark at the current row, a letter for its status, places and texts, a dash where blank."""
    s = T.persisted_status(F.col(status))
    code = F.when(s == "accepted", "A").when(s == "rejected", "R").otherwise("P")
    mark = F.when(F.col("position") == current, "->").otherwise("") if current is not None else F.lit("")
    texts = {c: T.html_text(F.col(c)) for c in ("raw_lab_name", "raw_value", "lab_name")}
    places = {c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("page_number", "result_index")}
    return queued.select("source_file", "position", mark.alias("current"), code.alias("status_code"), *(v.alias(k) for k, v in (places | texts).items()))


def exportable(rows: DataFrame, lab: str = "lab_name", unit: str = "lab_unit") -> DataFrame:
    """Rows of a lab that isn't unknown, in a unit. A null lab passes."""
    return rows.filter((F.coalesce(F.col(lab), F.lit("")) != UNKNOWN) & ~F.coalesce(F.col(unit), F.lit("")).isin("", UNKNOWN))


def export(rows: DataFrame) -> DataFrame:
    """The export's columns, in order and in type; what can't be cast is null, and missing columns are."""
    return rows.select(*(F.col(c).try_cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in EXPORT.items()))


def publish(rows: DataFrame, order: list[str], allow_pending: bool = False, status: str = "review_status") -> DataFrame:
    """Accepted rows, exportable, one for each date and lab, without the mark of duplicates; all rows where pending ones are allowed."""
    from assayflow.operators.dedup import prefer_primary

    kept = rows if allow_pending else rows.filter(T.persisted_status(F.col(status)) == "accepted")
    kept = prefer_primary(exportable(kept), order)
    reason = T.remove_reason(F.col("review_reason"), "DUPLICATE_ENTRY")
    return export(kept.withColumn("review_reason", reason).withColumn("review_needed", F.col("review_reason") != ""))
