"""Run the report catalogue and write every report to a folder.

    python -m shoplens.plans.run --csv /data/exports --out /data/reports [--format csv]
    python -m shoplens.plans.run --star /root/testdata/sf0.1 --out /tmp/reports

Each report is written once (``<out>/<name>``); with ``--format csv`` a
header line is included, as in the original hand-over of the cross-tab to
the statistics step. The session is the active one when called from code
(:func:`write_reports`), or a local one from the command line.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame

from shoplens.plans.cache import remove_run
from shoplens.plans.catalog import run_reports
from shoplens.sources.files import write_table


def write_reports(reports: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    written = []
    for name, df in reports.items():
        path = os.path.join(out_dir, name)
        write_table(df, path, fmt=fmt)
        written.append(path)
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder of raw CSV exports (one file per table)")
    src.add_argument("--star", help="folder of the TPC-H-like driver tables (Parquet)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--as-of", default=None, help="recency reference day (yyyy-MM-dd)")
    ap.add_argument("--reports", nargs="*", default=None)
    ap.add_argument("--import-to", default=None, help="with --csv: folder for the loaded tables (Parquet); records "
                                                      "that do not fit are written to <out>/reject_records")
    ap.add_argument("--single-line", nargs="*", default=[], help="with --csv: tables without line breaks in quotes")
    args = ap.parse_args(argv)

    from shoplens.session import get_spark
    spark = get_spark()
    if args.csv:
        from shoplens.sources.csv_tables import from_csv_folder
        tables = from_csv_folder(spark, args.csv, import_to=args.import_to, single_line=tuple(args.single_line),
                                 **({"as_of": args.as_of} if args.as_of else {}))
    else:
        from shoplens.sources.star_schema import from_star_schema
        tables = from_star_schema(spark, args.star)
        if args.as_of:
            tables.as_of = args.as_of
    reports = run_reports(tables, args.reports)
    if "reject_records" in tables.extra:
        reports["reject_records"] = tables.extra["reject_records"]
    for path in write_reports(reports, args.out, args.format):
        print(path)
    remove_run(spark)


if __name__ == "__main__":
    main()
