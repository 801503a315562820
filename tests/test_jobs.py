"""End to end: catalog sources -> training table -> models -> report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.config import TRAINING_COLUMNS
from attrition.plans.jobs import model_job, prepare_job
from attrition.plans.registry import FIXTURE, sources
from attrition.session import scratch_path
from tests.conftest import SF_SMALL


def test_prepare_then_model(spark):
    sources(spark, SF_SMALL).register()  # the nine sources under their warehouse names
    out = "churn_training_e2e"
    prepare_job(spark, out, cfg=FIXTURE, path=scratch_path(spark, out))
    training = spark.table(out)
    assert training.columns == TRAINING_COLUMNS
    assert training.count() == 275

    run = model_job(spark, out, report_prefix="e2e_report", cfg=FIXTURE, report_root=scratch_path(spark, "reports"))
    pred = run.predictions
    assert pred.where((F.col("p_churn") < 0) | (F.col("p_churn") > 1)).count() == 0
    assert {r.model for r in pred.select("model").distinct().collect()} == {
        "logistic_regression", "decision_tree", "gradient_boosting"
    }
    imp = run.reports["feature_importance"].groupBy("horizon").agg(F.sum("feature_importances").alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in imp.collect())
    table = spark.table("e2e_report_metrics_table")
    assert table.count() == 3 and "linear_regression_7" in table.columns
    assert spark.table("e2e_report_threshold_table").count() == 2
