"""Model evaluation as grouped aggregates.

Input is a prediction frame (horizon, model, student_id, label, prediction,
p_churn). All metrics of all models come from one grouped aggregate of 2x2
counts; only the small report reaches the driver, when it is shown.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.config import THRESHOLDS
from attrition.functions.labels import threshold_flag
from attrition.functions.ratios import safe_ratio, zero_if_undefined
from attrition.operators.ranking import running_sum

GROUP = ["horizon", "model"]


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def confusion_counts(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Tn, fp, fn, tp per group (zeros included)."""
    y, p = F.col("label"), F.col("prediction")
    return pred.groupBy(*group).agg(
        _count(~y & ~p).alias("tn"),
        _count(~y & p).alias("fp"),
        _count(y & ~p).alias("fn"),
        _count(y & p).alias("tp"),
    )


def confusion_long(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """The 2x2 matrix as rows (group..., actual, predicted, n)."""
    c = confusion_counts(pred, group)
    cells = "stack(4, false, false, tn, false, true, fp, true, false, fn, true, true, tp) as (actual, predicted, n)"
    return c.select(*group, F.expr(cells))


def confusion_table(pred: DataFrame, compat: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """The 2x2 matrix as two rows per group: (group..., row, col_false, col_true).

    Standard layout: rows are the actual class, columns the predicted one.
    ``compat``: the reference's layout, which passes (prediction, truth) and so
    gets rows = predicted, columns = actual, i.e. [[tn, fn], [fp, tp]] (M15).
    """
    c = confusion_counts(pred, group)
    if compat:
        cells = "stack(2, false, tn, fn, true, fp, tp) as (row, col_false, col_true)"
    else:
        cells = "stack(2, false, tn, fp, true, fn, tp) as (row, col_false, col_true)"
    return c.select(*group, F.expr(cells))


def with_threshold_flags(pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The prediction frame with one flag column ``thr_<pct>`` per
    threshold (``p_churn >= t``), as the reference's per-row lambdas."""
    return pred.select("*", *[threshold_flag("p_churn", t).alias(f"thr_{_thr_label(t)}") for t in thresholds])


def _standard(c: DataFrame) -> list[Column]:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    tpr = safe_ratio(tp, tp + fn)
    tnr = safe_ratio(tn, tn + fp)
    return [
        zero_if_undefined(tp, tp + fp).alias("precision"),
        zero_if_undefined(tp, tp + fn).alias("recall"),
        ((tpr + tnr) / F.lit(2.0)).alias("roc_auc"),
    ]


def _compat(c: DataFrame) -> list[Column]:
    """The reference passes (prediction, truth) to the metric functions, so its
    'precision' is recall, its 'recall' is precision and its 'ROC AUC' on hard
    labels is (PPV + NPV) / 2 (null when one predicted class is empty)."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ppv = safe_ratio(tp, tp + fp)
    npv = safe_ratio(tn, tn + fn)
    return [
        zero_if_undefined(tp, tp + fn).alias("ref_precision_score"),
        zero_if_undefined(tp, tp + fp).alias("ref_recall_score"),
        ((ppv + npv) / F.lit(2.0)).alias("ref_roc_auc_score"),
    ]


def model_metrics(pred: DataFrame, compat: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """One row per group with standard metrics (and the reference's swapped ones)."""
    c = confusion_counts(pred, group)
    cols = _standard(c) + (_compat(c) if compat else [])
    return c.select(*group, *cols)


def metrics_long(pred: DataFrame, compat: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """(group..., metric, value) rows; U2 as an unpivot of the metric columns."""
    wide = model_metrics(pred, compat, group)
    names = [c for c in wide.columns if c not in group]
    return wide.unpivot(list(group), names, "metric", "value")


REFERENCE_MODEL_NAMES = {
    "logistic_regression": "linear_regression",
    "decision_tree": "decision_tree",
    "gradient_boosting": "gradient_boosting",
}
REFERENCE_METRIC_NAMES = {
    "ref_precision_score": "precision_score",
    "ref_recall_score": "recall_score",
    "ref_roc_auc_score": "roc_auc_score",
}


def metrics_table(
    pred: DataFrame,
    horizons: Sequence[int],
    models: Sequence[str],
    compat: bool = True,
) -> DataFrame:
    """Metric rows x (model, horizon) columns, the reference's layout.

    With ``compat`` the rows are the reference's (swapped) metrics and the
    logistic columns carry its 'linear_regression' name.
    """
    long = metrics_long(pred, compat=compat)
    if compat:
        long = long.where(F.col("metric").startswith("ref_"))
        mapping = F.create_map(*[F.lit(x) for kv in REFERENCE_METRIC_NAMES.items() for x in kv])
        long = long.withColumn("metric", mapping[F.col("metric")])
    rename = F.create_map(*[F.lit(x) for kv in REFERENCE_MODEL_NAMES.items() for x in kv])
    label = F.concat_ws("_", F.coalesce(rename[F.col("model")], F.col("model")), F.col("horizon").cast("string"))
    columns = [f"{REFERENCE_MODEL_NAMES.get(m, m)}_{h}" for h in horizons for m in models]
    return long.withColumn("column", label).groupBy("metric").pivot("column", columns).agg(F.first("value"))


def _thr_label(t: float) -> str:
    """The threshold in percent, in full precision (0.85 -> 85, 0.851 -> 85_1)."""
    return f"{round(t * 100, 10):g}".replace(".", "_")


def threshold_metrics(pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, group: Sequence[str] = GROUP) -> DataFrame:
    """Recall and precision of ``p_churn >= t`` for every threshold.

    All thresholds are counted in one aggregate (one column set per
    threshold, no join against a threshold table), then unpivoted to
    (group..., threshold, recall, precision). Precision is 0 when nothing is
    flagged; recall is 0 when the group has no churners.
    """
    y = F.col("label")
    aggs = [F.sum(F.when(y, 1).otherwise(0)).cast("bigint").alias("pos")]
    for t in thresholds:
        flag = threshold_flag("p_churn", t)
        aggs += [_count(y & flag).alias(f"tp_{_thr_label(t)}"), _count(flag).alias(f"flag_{_thr_label(t)}")]
    c = pred.groupBy(*group).agg(*aggs)
    stack = ", ".join(f"{float(t)}D, tp_{_thr_label(t)}, flag_{_thr_label(t)}" for t in thresholds)
    long = c.select(*group, "pos", F.expr(f"stack({len(thresholds)}, {stack}) as (threshold, tp, flagged)"))
    return long.select(
        *group,
        "threshold",
        zero_if_undefined("tp", "pos").alias("recall"),
        zero_if_undefined("tp", "flagged").alias("precision"),
    )


def threshold_table(pred: DataFrame, horizons: Sequence[int], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Rows Recall / Precision, columns '<pct>_thr_<horizon>' (reference layout)."""
    m = threshold_metrics(pred, thresholds, group=["horizon"])
    long = m.unpivot(["horizon", "threshold"], ["recall", "precision"], "metric", "value").withColumn(
        "metric", F.initcap("metric")
    )
    named = F.lit(None).cast("string")
    for t in thresholds:
        named = F.when(F.col("threshold") == F.lit(float(t)), F.lit(_thr_label(t))).otherwise(named)
    label = F.concat(named, F.lit("_thr_"), F.col("horizon").cast("string"))
    columns = [f"{_thr_label(t)}_thr_{h}" for h in horizons for t in thresholds]
    return long.withColumn("column", label).groupBy("metric").pivot("column", columns).agg(F.first("value"))


def score_bucket(score: str) -> Column:
    """A bucket that never decreases with the score: 2^20 equal steps in [0, 1],
    logarithmic steps outside, the infinities and NaN at the ends."""
    s = F.col(score)
    steps, far = 1 << 20, 1 << 40
    log = lambda x: F.floor(F.log2(x) * F.lit(4096)).cast("long")
    return (
        F.when(F.isnan(s), F.lit(far + 1))
        .when(s == F.lit(float("inf")), F.lit(far))
        .when(s == F.lit(float("-inf")), F.lit(-far))
        .when(s > 1, F.lit(steps + 1) + log(s))
        .when(s < 0, F.lit(-1) - log(F.lit(1.0) - s))
        .otherwise(F.floor(s * F.lit(steps)))
        .cast("long")
    )


def roc_auc(pred: DataFrame, group: Sequence[str] = GROUP, score: str = "p_churn") -> DataFrame:
    """Area under the ROC curve of ``score`` per group, exactly (rank-sum form).

    AUC = (sum over churners of the mid-rank of their score - P(P+1)/2) / (P*N),
    with tied scores sharing their mid-rank. Ties are collapsed first (one
    row per group and score), then a bucketed running sum gives each score
    its first and last rank. All sums stay integers (twice the
    mid-rank) until the final division. Null when a class is empty.

    NaN ranks above all numbers, as Spark sorts it. Rows without a score have no
    rank: they are left out of both classes and counted in ``n_unscored``.
    """
    per_score = pred.groupBy(*group, score).agg(
        F.sum(F.when(F.col("label"), 1).otherwise(0)).cast("bigint").alias("_pos"),
        F.count(F.lit(1)).alias("_n"),
    )
    unscored = F.sum(F.when(F.col(score).isNull(), F.col("_n")).otherwise(0)).alias("n_unscored")
    missing = per_score.groupBy(*group).agg(unscored)
    # Rows with a smaller score, via a running sum over the distinct scores.
    through = running_sum(per_score.where(F.col(score).isNotNull()), group, [F.col(score)], F.col("_n"), "_through", score_bucket(score))
    ranked = through.withColumn("_lo", F.col("_through") - F.col("_n") + F.lit(1)).withColumn("_hi", F.col("_through"))
    g = ranked.groupBy(*group).agg(
        F.sum(F.col("_pos") * (F.col("_lo") + F.col("_hi"))).alias("_u2"),
        F.sum("_pos").alias("p"),
        F.sum("_n").alias("_all"),
    )
    p, n = F.col("p"), F.col("_all") - F.col("p")
    auc = F.try_divide((F.col("_u2") - p * (p + F.lit(1))).cast("double"), (F.lit(2) * p * n).cast("double"))
    auc_rows = g.select(*[F.col(c).alias(f"_g_{c}") for c in group], auc.alias("roc_auc"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    return missing.join(auc_rows, same, "left").select(*group, "roc_auc", "n_unscored")
