"""Dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayflow.functions.text import strip


def iso_date(c: Column) -> Column:
    """``DD/MM/YYYY``, ``DD-MM-YYYY`` or ISO to ISO text; blank, zero or other text is null. The calendar isn't checked."""
    s = strip(c)
    turned = F.regexp_replace(s, r"^(\d{2})[/-](\d{2})[/-](\d{4})$", "$3-$2-$1")
    return F.when((s != "0000-00-00") & turned.rlike(r"^\d{4}-\d{2}-\d{2}$"), turned)


def page_date(collection: Column, report: Column) -> Column:
    """The collection date, else the report date. A zero collection date hides the report date."""
    return F.nullif(F.coalesce(F.nullif(collection, F.lit("")), F.nullif(report, F.lit(""))), F.lit("0000-00-00"))


def name_date(stem: Column) -> Column:
    """The first ``YYYY-MM-DD`` in a file's name."""
    return F.nullif(F.regexp_extract(stem, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
