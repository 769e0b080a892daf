"""Batch entry points: the cleaning job and the report job.

The analysed workflow is two steps joined by a file: clean and export the
cohort, then load it and produce the tables.  The same here, as a script
for ``spark-submit`` (or ``python -m kohort.plans.jobs``)::

    clean  --data <dir with the source tables> --out <cohort path> [--version v1|v2]
    report --cohort <cohort path> --out <directory for the report tables>

The cohort is Parquet (types and NULLs survive the hand-over); the report
writes one Parquet table per result.  The session comes from the
platform; only its checkpoint folder is filled in when unset.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from kohort.plans import pipelines as P
from kohort.session import checkpoint_dir
from kohort.sources import io


def clean(spark: SparkSession, data_dir: str, out: str, version: str = "v1") -> str:
    """Run a cleaning pipeline over the source tables and write the cohort
    with its data dictionary beside it."""
    job = P.clean_registry if version == "v1" else P.clean_registry_v2
    cohort = job(spark, data_dir)
    io.write_clean(cohort, out)
    io.data_dictionary(io.read_clean(spark, out), path=out.rstrip("/") + "_dictionary")
    return out


def report(spark: SparkSession, cohort_path: str, out_dir: str) -> dict[str, str]:
    """Read a cleaned cohort and write every report table."""
    reg = io.read_clean(spark, cohort_path)
    tables = P.report_for(spark, reg)
    written = {}
    for name, df in tables.items():
        if isinstance(df, DataFrame):
            path = os.path.join(out_dir, name)
            io.write_clean(df, path)
            written[name] = path
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="kohort.plans.jobs")
    ap.add_argument("--master", default=None, help="only for local runs; spark-submit sets it")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("clean")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--version", choices=["v1", "v2"], default="v1")
    r = sub.add_parser("report")
    r.add_argument("--cohort", required=True)
    r.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    builder = SparkSession.builder.appName(f"kohort-{args.cmd}")
    if args.master:
        builder = builder.master(args.master).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    if args.cmd == "clean":
        print(clean(spark, args.data, args.out, args.version))
    else:
        for name, path in report(spark, args.cohort, args.out).items():
            print(name, path)


if __name__ == "__main__":
    main()
