"""Training table -> models -> reports (the modelling job, C10-C16)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import HORIZON_COL, ChurnConfig
from attrition.operators import evaluate, models, prepare, stats
from attrition.session import ensure_checkpoint_dir


@dataclass
class ModelData:
    frame: DataFrame  # model frame with is_test
    train: DataFrame  # balanced training rows
    test: DataFrame  # unbalanced test rows


def model_data(training: DataFrame, cfg: ChurnConfig = ChurnConfig(), checkpoint: bool = False) -> ModelData:
    """C10 + M2 + M3. With ``checkpoint`` the model frame is written to the
    shared checkpoint folder first, so the fits and reports re-read a short
    lineage instead of recomputing the feature job (and survive executor loss)."""
    frame = prepare.with_split(prepare.model_frame(training, cfg.horizons), cfg.split_seed, cfg.test_percent)
    if checkpoint:
        ensure_checkpoint_dir(frame.sparkSession)
        frame = frame.checkpoint(eager=True)
    train = prepare.balance(frame.where(~F.col("is_test")), HORIZON_COL, seed=cfg.split_seed)
    test = frame.where(F.col("is_test"))
    return ModelData(frame=frame, train=train, test=test)


@dataclass
class ModelRun:
    data: ModelData
    fitted: dict[int, models.HorizonModels]
    predictions: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)


REPORTS = (
    "model_metrics",
    "metrics_table",
    "confusion",
    "roc_auc",
    "threshold_table",
    "feature_importance",
    "correlation",
    "fit_report",
)


def run_models(
    training: DataFrame,
    cfg: ChurnConfig = ChurnConfig(),
    model_names: tuple[str, ...] = models.MODEL_NAMES,
    checkpoint: bool = True,
    reports: tuple[str, ...] = REPORTS,
) -> ModelRun:
    """Fit all horizons x models, score the test rows once, build the requested
    reports (lazy DataFrames, except correlation and importances, which run
    their small driver-side step when requested)."""
    data = model_data(training, cfg, checkpoint=checkpoint)
    train = data.train.persist()
    try:
        fitted = models.fit_all(train, cfg.horizons, model_names, cfg)
    finally:
        train.unpersist()
    pred = models.predictions(fitted, data.test)
    if checkpoint:
        pred = pred.checkpoint(eager=True)
    gbt = pred.where(F.col("model") == "gradient_boosting")
    builders = {
        "model_metrics": lambda: evaluate.model_metrics(pred, compat=True),
        "metrics_table": lambda: evaluate.metrics_table(pred, cfg.horizons, model_names, compat=True),
        "confusion": lambda: evaluate.confusion_long(pred),
        "roc_auc": lambda: evaluate.roc_auc(pred),
        "threshold_table": lambda: evaluate.threshold_table(gbt, cfg.horizons, cfg.thresholds),
        "feature_importance": lambda: models.feature_importance(fitted),
        "fit_report": lambda: models.fit_report(pred.sparkSession, fitted),
        "correlation": lambda: stats.correlation_matrix(data.frame),
    }
    needs_gbt = {"threshold_table", "feature_importance"}
    out = {
        name: builders[name]()
        for name in reports
        if name not in needs_gbt or "gradient_boosting" in model_names
    }
    return ModelRun(data=data, fitted=fitted, predictions=pred, reports=out)
