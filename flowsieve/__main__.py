"""``spark-submit -m flowsieve name=path [name=path ...] --output DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from flowsieve.operators import models
from flowsieve.plans.detector import DetectorConfig, run
from flowsieve.session import drop_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowsieve")
    parser.add_argument("sources", nargs="+", help="name=path, in stacking order")
    parser.add_argument("--output", required=True)
    parser.add_argument("--features", choices=["eliminate", "recorded", "all"], default="eliminate")
    parser.add_argument("--correlated", choices=["recorded", "measured"], default="recorded")
    parser.add_argument("--outliers", choices=["forest", "recorded"], default="forest")
    parser.add_argument("--centre", action="store_true", help="scale to zero mean as well")
    parser.add_argument("--select-inside-fold", action="store_true")
    parser.add_argument("--step", type=float, default=1)
    parser.add_argument("--parallelism", type=int, default=4)
    parser.add_argument("--forest-depth", type=int, default=5, help="of the forest classifier, up to 30")
    parser.add_argument("--journal", help="folder for this job's finished fits; the same again resumes it")
    parser.add_argument("--run-id", help="a report is appended once per id (default: a new one)")
    args = parser.parse_args(argv)
    cfg = DetectorConfig(
        sources=dict(s.split("=", 1) for s in args.sources),
        features=args.features,
        correlated=args.correlated,
        outliers=args.outliers,
        centre=args.centre,
        select_inside_fold=args.select_inside_fold,
        step=args.step,
        parallelism=args.parallelism,
        models=[models.logistic(), models.forest(max_depth=args.forest_depth), models.perceptron()],
        journal=args.journal,
    )
    spark = SparkSession.builder.appName("flowsieve").getOrCreate()
    try:
        result = run(spark, cfg, args.output, args.run_id)
        print(f"columns: {result.widths}")
        print(f"features: {result.selected}")
    finally:
        drop_tables(spark)


if __name__ == "__main__":
    main()
