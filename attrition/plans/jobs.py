"""The batch jobs of the workload, over catalog tables.

prepare:  source tables -> training table (overwritten, schema merged)
publish:  source tables -> bucketed tables, from which ``prepare --published`` builds
          the training table without shuffling students
model:    training table -> 9 fitted models -> report tables

    python -m attrition.plans.jobs prepare --out churn_training_data
    python -m attrition.plans.jobs publish --prefix churn --path hdfs:///churn --buckets 4096
    python -m attrition.plans.jobs prepare --out churn_training_data --published churn
    python -m attrition.plans.jobs model --training churn_training_data --reports churn_report
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from attrition.config import ChurnConfig
from attrition.plans import bucketed
from attrition.plans.modelling import ModelRun, run_models
from attrition.plans.training_table import build_training_table
from attrition.session import apply_cluster_conf, apply_engine_conf
from attrition.sources.bundle import ChurnSources
from attrition.sources.tables import save_training_table

TRAINING_TABLE = "churn_training_data"


def prepare_job(
    spark: SparkSession,
    out_table: str = TRAINING_TABLE,
    tables: dict[str, str] | None = None,
    cfg: ChurnConfig = ChurnConfig(),
    path: str | None = None,
    published: str | None = None,
) -> None:
    """Build the training table from the catalog's source tables, or from the bucketed
    tables with the prefix ``published``, and overwrite ``out_table``."""
    apply_engine_conf(spark)
    if published is not None:
        training = bucketed.build(spark, bucketed.BucketedTables(published), cfg)
    else:
        training = build_training_table(ChurnSources.from_catalog(spark, tables), cfg)
    save_training_table(training, out_table, merge_schema=True, path=path)


def publish_job(
    spark: SparkSession, prefix: str, path: str, n_buckets: int, tables: dict[str, str] | None = None, cfg: ChurnConfig = ChurnConfig()
) -> bucketed.BucketedTables:
    """Write the bucketed tables of the catalog's source tables."""
    apply_engine_conf(spark)
    return bucketed.publish(ChurnSources.from_catalog(spark, tables), prefix, path, n_buckets, cfg)


def model_job(
    spark: SparkSession,
    training_table: str = TRAINING_TABLE,
    report_prefix: str | None = None,
    cfg: ChurnConfig = ChurnConfig(),
    report_root: str | None = None,
) -> ModelRun:
    """Fit and evaluate all horizons; with ``report_prefix`` every report is
    written as table ``<prefix>_<report>`` (reports are small: one row per
    metric, feature or matrix cell), stored under ``report_root`` when given."""
    apply_engine_conf(spark)
    run = run_models(spark.table(training_table), cfg)
    if report_prefix:
        for name, df in run.reports.items():
            writer = df.write.mode("overwrite")
            if report_root:
                writer = writer.option("path", f"{report_root}/{name}")
            writer.saveAsTable(f"{report_prefix}_{name}")
    return run


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="attrition.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    prep = sub.add_parser("prepare")
    prep.add_argument("--out", default=TRAINING_TABLE)
    prep.add_argument("--as-of", default=None)
    prep.add_argument("--label-day", type=int, default=ChurnConfig().label_day)
    prep.add_argument("--published", default=None)
    publish = sub.add_parser("publish")
    publish.add_argument("--prefix", required=True)
    publish.add_argument("--path", required=True)
    publish.add_argument("--buckets", type=int, required=True)
    publish.add_argument("--label-day", type=int, default=ChurnConfig().label_day)
    model = sub.add_parser("model")
    model.add_argument("--training", default=TRAINING_TABLE)
    model.add_argument("--reports", default="churn_report")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    apply_cluster_conf(spark)
    if args.job == "prepare":
        prepare_job(spark, args.out, cfg=ChurnConfig(label_day=args.label_day, as_of=args.as_of), published=args.published)
    elif args.job == "publish":
        publish_job(spark, args.prefix, args.path, args.buckets, cfg=ChurnConfig(label_day=args.label_day))
    else:
        model_job(spark, args.training, args.reports)


if __name__ == "__main__":
    main()
