"""Classifiers per horizon (C12, M6-M11) and feature importance."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.config import (
    CATEGORICAL_FEATURES,
    GBT_DEPTH,
    GBT_STEP,
    GBT_TREES,
    HORIZON_COL,
    LABEL,
    LOGREG_MAX_ITER,
    MODEL_COLUMNS,
    SPLIT_SEED,
    TREE_MAX_DEPTH,
    ChurnConfig,
)
from attrition.operators.dictionary import FEATURES, LevelEncoder, fit_levels

MODEL_NAMES = ("logistic_regression", "decision_tree", "gradient_boosting")
TARGET = "_y"


def estimator(name: str, horizon: int, n_train: int, cfg: ChurnConfig = ChurnConfig()):
    if name == "logistic_regression":
        # L2 with C=1 on a summed loss = regParam 1/n on Spark's mean loss;
        # features are not standardised in that objective.
        return LogisticRegression(
            featuresCol=FEATURES,
            labelCol=TARGET,
            maxIter=LOGREG_MAX_ITER.get(horizon, 1000),
            tol=cfg.logreg_tol,
            regParam=1.0 / max(n_train, 1),
            elasticNetParam=0.0,
            standardization=False,
        )
    if name == "decision_tree":
        # Deep tree: cache each row's node id between levels (checkpointed every
        # 10 levels to the shared folder) instead of re-routing rows through
        # the growing tree on every pass.
        return DecisionTreeClassifier(
            featuresCol=FEATURES,
            labelCol=TARGET,
            maxDepth=TREE_MAX_DEPTH,
            maxBins=cfg.max_bins,
            seed=SPLIT_SEED,
            cacheNodeIds=True,
            checkpointInterval=10,
        )
    if name == "gradient_boosting":
        return GBTClassifier(
            featuresCol=FEATURES,
            labelCol=TARGET,
            maxIter=GBT_TREES,
            stepSize=GBT_STEP,
            maxDepth=GBT_DEPTH,
            maxBins=cfg.max_bins,
            seed=SPLIT_SEED,
        )
    raise ValueError(f"unknown model {name!r}")


@dataclass
class HorizonModels:
    """One horizon's encoder and the models fitted on its output."""

    encoder: LevelEncoder
    n_rows: int
    models: dict[str, Model]

    def score(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` encoded and with the model's output columns."""
        return self.models[name].transform(self.encoder.transform(rows))


def fit_partitions(n_rows: int, width: int, cfg: ChurnConfig = ChurnConfig()) -> int:
    """Partitions of a fitting set, from its encoded size (8 bytes a slot)."""
    return max(1, -(-n_rows * width * 8 // cfg.fit_partition_bytes))


def fit_all(
    balanced: DataFrame,
    horizons: Sequence[int],
    models: Sequence[str] = MODEL_NAMES,
    cfg: ChurnConfig = ChurnConfig(),
    categoricals: Sequence[str] = CATEGORICAL_FEATURES,
    columns: Sequence[str] = MODEL_COLUMNS,
) -> dict[int, HorizonModels]:
    """One encoder for each horizon, then every model on its output.

    The caller owns ``balanced`` (and its caching). The encoded rows of each
    horizon are persisted for its fits and released after; all (horizon, model)
    pairs are fitted as concurrent Spark jobs, since small iterative fits are
    bound by job latency rather than by cluster capacity. A horizon without rows,
    or with one class only, is an error that names it.
    """
    found = balanced.groupBy(HORIZON_COL).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(LABEL).alias("classes")).collect()
    sizes = {int(r[0]): int(r.n) for r in found}
    poor = [h for h in horizons if h not in sizes] + [int(r[0]) for r in found if r[0] in horizons and r.classes < 2]
    if poor:
        raise ValueError(f"no balanced training rows of both classes on horizon days {sorted(poor)}")
    kept: dict[int, tuple[LevelEncoder, DataFrame]] = {}
    try:

        def encode(h: int):
            rows = balanced.where(F.col(HORIZON_COL) == h)
            enc = fit_levels(rows, categoricals, columns)
            out = enc.transform(rows).withColumn(TARGET, F.col(LABEL).cast("double")).select(FEATURES, TARGET)
            out = out.repartition(fit_partitions(sizes[h], enc.width, cfg)).persist()
            out.count()
            return h, (enc, out)

        def fit(pair: tuple[int, str]):
            h, name = pair
            return h, name, estimator(name, h, sizes[h], cfg).fit(kept[h][1])

        with ThreadPoolExecutor(max_workers=max(1, len(horizons) * len(models))) as pool:
            kept.update(pool.map(encode, horizons))
            results = list(pool.map(fit, [(h, m) for h in horizons for m in models]))
        return {h: HorizonModels(kept[h][0], sizes[h], {m: model for g, m, model in results if g == h}) for h in horizons}
    finally:
        for _, rows in kept.values():
            rows.unpersist()


def fit_report(spark: SparkSession, fitted: dict[int, HorizonModels]) -> DataFrame:
    """How each fit ended: iterations of the logistic fits and whether the limit
    stopped them; depth and nodes of the trees and whether a tree reached the depth
    limit (Spark's ceiling of 30 for the single tree), so that a cut tree is seen."""
    rows = []
    for h, hm in fitted.items():
        for name, m in hm.models.items():
            if name == "logistic_regression":
                done = m.summary.totalIterations
                rows.append((h, name, hm.n_rows, done, None, None, done >= m.getMaxIter()))
            elif name == "decision_tree":
                rows.append((h, name, hm.n_rows, None, m.depth, m.numNodes, m.depth >= TREE_MAX_DEPTH))
            else:
                rows.append((h, name, hm.n_rows, m.getNumTrees, max(t.depth for t in m.trees), m.totalNumNodes, False))
    return spark.createDataFrame(rows, "horizon int, model string, n_rows long, iterations int, depth int, nodes int, hit_limit boolean")


INTERCEPT = "(intercept)"


def with_values(enc: LevelEncoder, values: Sequence[float], out: str) -> DataFrame:
    """(slot, feature, ``out``): the encoder's features with a model's number of each slot
    (numbers other than zero travel; the model holds one a slot)."""
    some = [(i, float(v)) for i, v in enumerate(values) if v]
    told = enc.levels.sparkSession.createDataFrame(some, f"slot long, {out} double")
    return enc.features().join(told, "slot", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def optimality(
    fitted: dict[int, HorizonModels],
    balanced: DataFrame,
    tolerance: float = 1e-5,
) -> DataFrame:
    """M6: certificate of the logistic fits, (horizon, feature_name, gradient, spread,
    within_bound) for every feature and the intercept.

    The objective is the mean log loss plus |w|^2 / (2 n); it is convex, so weights are
    the minimum iff its gradient is zero. The gradient at the fitted weights on the
    rows of the fit takes one aggregate over the rows' non-zero cells (so no vector of
    the full width is exploded); ``within_bound``: at most ``tolerance`` standard
    deviations of the feature (of one unit, for a constant feature)."""
    frames = []
    for h, hm in fitted.items():
        model = hm.models["logistic_regression"]
        rows = balanced.where(F.col(HORIZON_COL) == h)
        residual = vector_to_array(model.getProbabilityCol())[1] - F.col(LABEL).cast("double")
        scored = hm.score("logistic_regression", rows).select(*rows.columns, residual.alias("_off"), F.lit(1.0).alias(INTERCEPT))
        cells = hm.encoder.explode(scored, ["_off"], [INTERCEPT])
        sums = cells.groupBy("feature").agg(
            F.sum(F.col("_off") * F.col("value")).alias("_off"), F.sum("value").alias("_sum"), F.sum(F.col("value") * F.col("value")).alias("_squares")
        )
        every = with_values(hm.encoder, model.coefficients.toArray(), "_w").select("feature", "_w")
        every = every.unionByName(balanced.sparkSession.createDataFrame([(INTERCEPT, 0.0)], "feature string, _w double"))  # not penalised
        n = F.lit(float(hm.n_rows))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        spread = F.sqrt(F.greatest(zero("_squares") / n - (zero("_sum") / n) * (zero("_sum") / n), F.lit(0.0)))
        told = every.join(sums, "feature", "left").select(
            F.lit(int(h)).alias("horizon"), F.col("feature").alias("feature_name"), ((zero("_off") + F.col("_w")) / n).alias("gradient"), spread.alias("spread")
        )
        frames.append(told.withColumn("within_bound", F.abs("gradient") <= tolerance * F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0))))
    return reduce(DataFrame.unionByName, frames)


def predictions(fitted: dict[int, HorizonModels], test: DataFrame) -> DataFrame:
    """(horizon, model, student_id, label, prediction, p_churn) on test rows.

    Each horizon's rows are encoded once; its models add their columns to the same
    rows, which are then unpivoted."""
    frames = []
    for h, hm in fitted.items():
        rows = hm.encoder.transform(test.where(F.col(HORIZON_COL) == h)).select("student_id", F.col(LABEL).alias("label"), FEATURES)
        cells = []
        for i, (name, model) in enumerate(hm.models.items()):
            own = model.copy({model.predictionCol: f"_c{i}", model.probabilityCol: f"_p{i}", model.rawPredictionCol: f"_r{i}"})
            rows = own.transform(rows)
            cells.append(f"'{name}', _c{i} = 1.0, _q{i}")
        for i in range(len(cells)):
            rows = rows.withColumn(f"_q{i}", vector_to_array(f"_p{i}")[1])
        long = rows.select("student_id", "label", F.expr(f"stack({len(cells)}, {', '.join(cells)}) as (model, prediction, p_churn)"))
        frames.append(long.select(F.lit(h).alias("horizon"), "model", "student_id", "label", "prediction", "p_churn"))
    return reduce(DataFrame.unionByName, frames)


def feature_importance(fitted: dict[int, HorizonModels], model: str = "gradient_boosting") -> DataFrame:
    """M20 + O1: (horizon, feature_name, feature_importances), most important first.

    One row for each feature and horizon; the names come from the encoder's dictionary.
    """
    frames = []
    for h, hm in fitted.items():
        told = with_values(hm.encoder, hm.models[model].featureImportances.toArray(), "feature_importances")
        frames.append(told.select(F.lit(int(h)).alias("horizon"), F.col("feature").alias("feature_name"), "feature_importances"))
    return reduce(DataFrame.unionByName, frames).orderBy("horizon", F.desc("feature_importances"), "feature_name")


def ranked_importance(importance: DataFrame, digits: int = 6) -> DataFrame:
    """O1: the report's order as a column: features of some importance with their rank
    in the horizon (rounded; equal ones by name)."""
    some = importance.withColumn("feature_importances", F.round("feature_importances", digits)).where("feature_importances > 0")
    order = Window.partitionBy("horizon").orderBy(F.desc("feature_importances"), "feature_name")
    return some.withColumn("rank", F.row_number().over(order)).select("horizon", "rank", "feature_name", "feature_importances")
