"""python -m assayflow review|export --pages DIR --specs FILE --names FILE --units FILE --out DIR"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from assayflow.operators.specs import Specs
from assayflow.plans import lab
from assayflow.sources import pages, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="assayflow", description=__doc__)
    parser.add_argument("what", choices=("review", "export"))
    for name in ("pages", "specs", "names", "units", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--allow-pending", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("assayflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    context = lab.Context(Specs.from_json(spark, args.specs), pages.load_cache(spark, args.names), pages.load_cache(spark, args.units, "unit"))
    rows = lab.read_rows(spark, args.pages)
    out = lab.review_ledger(rows, context) if args.what == "review" else lab.final_export(rows, context, allow_pending=args.allow_pending)
    sinks.write_table(out, args.out, args.format)


if __name__ == "__main__":
    main()
