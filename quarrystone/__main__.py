"""Command line: list the queries, run one into a folder, or profile a folder of files."""

from __future__ import annotations

import argparse


def main() -> None:
    p = argparse.ArgumentParser(prog="quarrystone")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="Parquet folder; without it the first rows are shown")
    prof = sub.add_parser("profile")
    prof.add_argument("folder")
    a = p.parse_args()
    from quarrystone.queries import all_queries

    known = all_queries()
    if a.what == "list":
        print("\n".join(known))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "run":
        df = known[a.query](spark, a.tables)
    else:
        from quarrystone.plans.pipelines import profile_folder

        df = profile_folder(spark, a.folder)
    if a.what == "run" and a.out:
        df.write.parquet(a.out)
    else:
        df.show(20, truncate=False, vertical=a.what == "profile")


if __name__ == "__main__":
    main()
