"""``python -m farebox purchases.csv out [--as-of 2024-05-01] [--only rfm,kpi_overview]``"""

import argparse
import datetime

from pyspark.sql import SparkSession

from farebox.plans.reports import NEEDS, REPORTS, update_months, write_reports
from farebox.plans.workspace import Workspace


def main() -> None:
    parser = argparse.ArgumentParser(prog="farebox", description=__doc__)
    parser.add_argument("purchases", help="a .csv or .parquet path")
    parser.add_argument("out", help="folder for the result tables")
    parser.add_argument("--as-of", type=datetime.date.fromisoformat, help="default: today")
    parser.add_argument("--personas", help="text file of 'segment: description' lines")
    parser.add_argument("--only", help="comma-separated analyses; default: all")
    parser.add_argument("--months", help="folder of a month store that takes these purchases in")
    parser.add_argument("--batch", default="purchases", help="name of these purchases in the month store")
    args = parser.parse_args()
    names = args.only.split(",") if args.only else None
    unknown = sorted(set(names or []) - set(REPORTS))
    if unknown:
        parser.error(f"unknown analyses {', '.join(unknown)}; there are {', '.join(REPORTS)}")
    spark = SparkSession.builder.appName("farebox").getOrCreate()
    workspace = Workspace.read(spark, args.purchases, args.as_of, args.personas)
    try:
        for name in write_reports(workspace, args.out, names):
            print(f"left out, a column is missing: {name} needs {', '.join(NEEDS[name])}")
        if args.months:
            for month in update_months(workspace, args.months, args.batch):
                print(f"month replaced: {month:%Y-%m}")
    finally:
        workspace.close()
        spark.stop()


if __name__ == "__main__":
    main()
