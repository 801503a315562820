"""Named queries over the role views of a test-data folder (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import HORIZON_COL, LABEL, LESSON_COLUMNS, SESSION_COLUMNS, SPINE_COLUMNS, ChurnConfig
from attrition.operators import dictionary, evaluate, models, prepare, scoring, stats
from attrition.plans import bucketed, modelling
from attrition.operators.ranking import exact_row_number
from attrition.operators.spine import build_spine
from attrition.plans import training_table as tt
from attrition.session import apply_engine_conf, delete_on_exit, scratch_path
from attrition.sources import snapshots
from attrition.sources.files_source import FORMAT as FILES_FORMAT
from attrition.sources.roles import role_sources
from attrition.sources.tables import read_table, save_training_table

# Fixture parameters: the test data spans 30 days, so the label is taken on
# day 24 after the first subscription (33 would make every row churned).
FIXTURE = ChurnConfig(label_day=24)
KEY = ["student_id", "date_dt"]

Query = Callable[[SparkSession, str], DataFrame]


def sources(spark: SparkSession, sf_dir: str):
    apply_engine_conf(spark)
    return role_sources(spark, sf_dir)


def rough_sources(spark: SparkSession, sf_dir: str):
    apply_engine_conf(spark)
    return role_sources(spark, sf_dir, rough=True)


def q_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources(spark, sf_dir).register()
    return read_table(spark, "dim_lesson")


def q_read_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources(spark, sf_dir).register()
    return read_table(spark, "dim_lesson", condition="lesson_status IN ('COMPLETED', 'AUTOCOMPLETED')")


def q_read_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 outside the catalog: the source drops the rows, Spark sums up what is left."""
    apply_engine_conf(spark)
    rows = read_table(
        spark,
        "events",
        condition="event_type IN ('purchase', 'signup') AND user_id >= 20 AND user_id <> 33 AND value > 10.5",
        fmt=FILES_FORMAT,
        options={"root": sf_dir, "columns": "event_id,user_id,event_type,value"},
    )
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"), F.max("value").alias("top_value"))


def q_read_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources(spark, sf_dir).register()
    return read_table(
        spark,
        "ignored_when_query_given",
        condition="ignored",
        query=(
            "SELECT user_id, count(*) AS n_sessions, CAST(sum(pages_viewed) AS BIGINT) AS pages "
            "FROM dim_session WHERE app_version IS NOT NULL GROUP BY user_id"
        ),
    )


def q_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    return build_spine(src.dim_student, src.dim_date, FIXTURE.calendar_start, FIXTURE.as_of, FIXTURE.label_day)


def q_single_sub_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    return tt.cohort_frames(src, FIXTURE).spine.select(*SPINE_COLUMNS)


def _group_query(group: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = sources(spark, sf_dir)
        return tt.feature_frame(src, (group,), FIXTURE, key_columns=KEY)

    run.__name__ = f"q_{group}_features"
    return run


def q_status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    return tt.feature_frame(src, ("status",), FIXTURE, key_columns=KEY)


def q_training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.build_training_table(sources(spark, sf_dir), FIXTURE)


def q_training_table_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of sources with calendar gaps, unknown staff flags, repeated
    lesson ids and users with two first packages."""
    return tt.build_training_table(rough_sources(spark, sf_dir), FIXTURE)


def q_lesson_features_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.feature_frame(rough_sources(spark, sf_dir), ("lessons",), FIXTURE, key_columns=KEY)


_PUBLISHED: dict[tuple[str, str], bucketed.BucketedTables] = {}


def published(spark: SparkSession, sf_dir: str) -> bucketed.BucketedTables:
    """The folder's sources as bucketed tables, published once an application; files
    are removed when the driver's JVM ends."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        path = scratch_path(spark, "bucketed")
        n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _PUBLISHED[key] = bucketed.publish(sources(spark, sf_dir), f"churn_{uuid.uuid4().hex[:8]}", path, n_buckets, FIXTURE)
        delete_on_exit(spark, path)
    return _PUBLISHED[key]


def q_training_table_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_engine_conf(spark)
    return bucketed.build(spark, published(spark, sf_dir), FIXTURE)


def relational_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "read_table": q_read_table,
        "read_filtered": q_read_filtered,
        "read_query": q_read_query,
        "read_external": q_read_external,
        "spine": q_spine,
        "single_sub_cohort": q_single_sub_cohort,
    }
    for g in ("session", "message", "lesson", "search"):
        group = {"session": "sessions", "message": "messages", "lesson": "lessons", "search": "search"}[g]
        q[f"{g}_features"] = _group_query(group)
    q["payment_features"] = _group_query("payment")
    q["status_label"] = q_status_label
    q["training_table"] = q_training_table
    q["training_table_bucketed"] = q_training_table_bucketed
    q["training_table_rough"] = q_training_table_rough
    q["lesson_features_rough"] = q_lesson_features_rough
    return q


_SAVED: dict[tuple[str, str], str] = {}


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved training table: written once for a folder and application by the
    data-preparation job, read by every model-side query, as the workload's second
    job reads what the first one stored. Removed when the driver's JVM ends."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = scratch_path(spark, "training-table")
        tt.build_training_table(sources(spark, sf_dir), FIXTURE).write.parquet(path)
        delete_on_exit(spark, path)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key])


def forget_saved_tables() -> None:
    """Let the next model-side query build its training table anew, and the next query
    over bucketed tables publish them anew."""
    _SAVED.clear()
    _PUBLISHED.clear()


def _data(spark: SparkSession, sf_dir: str):
    apply_engine_conf(spark)
    return modelling.model_data(_training(spark, sf_dir), FIXTURE)


def q_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.model_frame(_training(spark, sf_dir), FIXTURE.horizons)


def q_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir).frame


def q_balanced_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir).train


def q_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.class_counts(_data(spark, sf_dir).frame.where(~F.col("is_test")))


def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(q_model_frame(spark, sf_dir))


def q_one_hot_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    frames = []
    for h in FIXTURE.horizons:
        enc = dictionary.fit_levels(data.train.where(F.col(HORIZON_COL) == h))
        test = data.test.where(F.col(HORIZON_COL) == h).withColumn("horizon", F.col(HORIZON_COL))
        frames.append(enc.explode(test, ["horizon", "student_id"]))
    return reduce(DataFrame.unionByName, frames)


def _rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rule_predictions(_data(spark, sf_dir).test)


def q_rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_predictions(spark, sf_dir)


def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_long(_rule_predictions(spark, sf_dir))


def q_confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_table(_rule_predictions(spark, sf_dir))


def q_confusion_table_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_table(_rule_predictions(spark, sf_dir), compat=True)


def q_prediction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_threshold_flags(_rule_predictions(spark, sf_dir), FIXTURE.thresholds)


def q_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.model_metrics(_rule_predictions(spark, sf_dir), compat=True)


def q_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_table(_rule_predictions(spark, sf_dir), FIXTURE.horizons, list(scoring.RULES), compat=True)


def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_metrics(_rule_predictions(spark, sf_dir), FIXTURE.thresholds)


def q_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _rule_predictions(spark, sf_dir).where(F.col("model") == "score_recency")
    return evaluate.threshold_table(pred, FIXTURE.horizons, FIXTURE.thresholds)


def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_rule_predictions(spark, sf_dir))


def _fit_query(model_name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = _data(spark, sf_dir)
        fitted = models.fit_all(data.train, FIXTURE.horizons, (model_name,))
        return models.predictions(fitted, data.test)

    run.__name__ = f"q_fit_{model_name}"
    return run


def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    fitted = models.fit_all(data.train, FIXTURE.horizons, ("gradient_boosting",))
    return models.feature_importance(fitted)


def _saved_name(spark: SparkSession, what: str, sf_dir: str) -> tuple[str, str]:
    """Name and folder of a table that each call of a query saves anew: one a folder
    and application, so calls leave no further tables; removed when the JVM ends."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _NAMES:
        name = f"churn_{what}_{uuid.uuid4().hex[:8]}"
        _NAMES[key] = name, scratch_path(spark, name)
        delete_on_exit(spark, _NAMES[key][1])
    return _NAMES[key]


_NAMES: dict[tuple[str, str, str], tuple[str, str]] = {}


def q_save_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _saved_name(spark, "training", sf_dir)
    save_training_table(_training(spark, sf_dir), name, merge_schema=True, path=path)
    return spark.table(name)


def q_save_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A save without the session columns over one without the lesson columns;
    the stored table has both, the lesson columns of the new rows and no sessions."""
    name, path = _saved_name(spark, "merge", sf_dir)
    training = _training(spark, sf_dir)
    save_training_table(training.drop(*LESSON_COLUMNS), name, merge_schema=False, path=path)
    save_training_table(training.drop(*SESSION_COLUMNS), name, path=path)
    return spark.table(name)


def q_save_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the name sees after a save that stopped before it was
    published and one that stopped right after: the rows stored before them; and what
    the newest snapshot holds then. (reader, n rows, their largest day number)"""
    name, path = _saved_name(spark, "interrupted", sf_dir)
    training = _training(spark, sf_dir)
    first = save_training_table(training, name, path=path)
    early = training.where(F.col(HORIZON_COL) <= 7)
    late = snapshots.save(early, f"{name}_other", path, first)  # published, but ``name`` is not moved
    try:  # a writer that still works on the first version
        snapshots.save(training.limit(1), name, path, first)
        raise AssertionError("two writers published one version")
    except snapshots.PublishConflict:
        pass
    told = lambda df, who: df.agg(F.lit(who).alias("reader"), F.count(F.lit(1)).alias("n"), F.max(HORIZON_COL).alias("last_day"))
    by_name, newest = told(spark.table(name), "name"), told(snapshots.read_snapshot(spark, path, late.version), "newest")
    return by_name.unionByName(newest)


def q_spine_repeated_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine of a student table that repeats every third id with a first
    subscription four days later."""
    src = sources(spark, sf_dir)
    later = src.dim_student.where("id % 3 = 0").withColumn(
        "first_subscription_package_ts", F.col("first_subscription_package_ts") + F.expr("INTERVAL 4 DAYS")
    )
    students = src.dim_student.unionByName(later)
    return build_spine(students, src.dim_date, FIXTURE.calendar_start, FIXTURE.as_of, FIXTURE.label_day)


def q_payment_order_without_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers where every seventh order has no date (those come first)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("o_day")
    )
    return exact_row_number(orders, ["o_custkey"], ["o_day", "o_orderkey"], out="order_no", bucket=F.unix_date("o_day")).withColumn(
        "order_no", F.col("order_no").cast("bigint")
    )


def _gappy_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule predictions where some scores are null, NaN or above one."""
    sid, p = F.col("student_id") % 9, F.col("p_churn")
    gappy = F.when(sid == 1, F.lit(None).cast("double")).when(sid == 2, F.lit(float("nan"))).when(sid == 3, p + F.lit(1.5)).otherwise(p)
    return _rule_predictions(spark, sf_dir).withColumn("p_churn", gappy)


def q_roc_auc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_gappy_predictions(spark, sf_dir))


def q_prediction_flags_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = evaluate.with_threshold_flags(_gappy_predictions(spark, sf_dir), FIXTURE.thresholds)
    return flagged.drop("p_churn", "prediction")


#: Fits on a label that SQL can compute: the rows of one level of a category.
RULE_COLUMN, RULE_LEVEL = "language_version", "lv2"


def _rule_data(spark: SparkSession, sf_dir: str):
    data = _data(spark, sf_dir)
    ruled = lambda df: df.withColumn(LABEL, F.col(RULE_COLUMN) == F.lit(RULE_LEVEL))
    frame = ruled(data.frame)
    return frame.where(~F.col("is_test")), frame.where(F.col("is_test"))


def _fit_rule_query(model_name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _rule_data(spark, sf_dir)
        narrow = {"categoricals": [RULE_COLUMN], "columns": [RULE_COLUMN]} if model_name == "logistic_regression" else {}
        fitted = models.fit_all(train, FIXTURE.horizons, (model_name,), FIXTURE, **narrow)
        return models.predictions(fitted, test).drop("p_churn")

    run.__name__ = f"q_fit_{model_name}_rule"
    return run


def q_feature_importance_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _rule_data(spark, sf_dir)
    fitted = models.fit_all(train, FIXTURE.horizons, ("decision_tree",), FIXTURE)
    return models.feature_importance(fitted, "decision_tree").where("feature_importances > 0")


def q_feature_importance_boosted_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20 for the model that the report uses: all boosted trees split on the rule's level."""
    train, _ = _rule_data(spark, sf_dir)
    fitted = models.fit_all(train, FIXTURE.horizons, ("gradient_boosting",), FIXTURE)
    return models.ranked_importance(models.feature_importance(fitted))


#: A second category level; rows of either level are the label of a rule of two columns.
SECOND_COLUMN, SECOND_LEVEL = "region", "ASIA"


def q_feature_importance_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: ranked importances of a tree that needs two features."""
    train = _data(spark, sf_dir).frame.where(~F.col("is_test"))
    either = (F.col(RULE_COLUMN) == RULE_LEVEL) | (F.col(SECOND_COLUMN) == SECOND_LEVEL)
    columns = [SECOND_COLUMN, RULE_COLUMN]
    train = train.withColumn("_either", either).drop(LABEL).withColumnRenamed("_either", LABEL)
    fitted = models.fit_all(train, FIXTURE.horizons, ("decision_tree",), FIXTURE, columns, columns)
    return models.ranked_importance(models.feature_importance(fitted, "decision_tree"))


def q_tree_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a tree on a category of two levels with the real label.
    They are the levels' shares of churners in the fitting rows, or the share in all of
    them where both levels get the same class (Spark joins such leaves)."""
    data = _data(spark, sf_dir)
    two = lambda df: df.withColumn(RULE_COLUMN, F.when(F.col(RULE_COLUMN) == RULE_LEVEL, F.lit(RULE_LEVEL)).otherwise(F.lit("other")))
    fitted = models.fit_all(two(data.train), FIXTURE.horizons, ("decision_tree",), FIXTURE, [RULE_COLUMN], [RULE_COLUMN])
    return models.predictions(fitted, two(data.test)).select("horizon", "student_id", "label", "prediction", "p_churn")


def q_logistic_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 at full width: every feature's gradient is zero at the fitted weights."""
    train = _data(spark, sf_dir).train.persist()
    try:
        fitted = models.fit_all(train, FIXTURE.horizons, ("logistic_regression",), FIXTURE)
    finally:
        train.unpersist()
    return models.optimality(fitted, train).select("horizon", "feature_name", "within_bound")


def q_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 9 fits, scored once, as the reference's metric table (rows-only check)."""
    return modelling.run_models(_training(spark, sf_dir), FIXTURE, reports=("metrics_table",)).reports["metrics_table"]


def model_queries() -> dict[str, Query]:
    return {
        "model_frame": q_model_frame,
        "train_test_split": q_train_test_split,
        "balanced_train": q_balanced_train,
        "class_counts": q_class_counts,
        "correlation_matrix": q_correlation_matrix,
        "one_hot_encoded": q_one_hot_encoded,
        "rule_predictions": q_rule_predictions,
        "confusion_matrix": q_confusion_matrix,
        "confusion_table": q_confusion_table,
        "confusion_table_compat": q_confusion_table_compat,
        "prediction_flags": q_prediction_flags,
        "model_metrics": q_model_metrics,
        "metrics_table": q_metrics_table,
        "threshold_sweep": q_threshold_sweep,
        "threshold_table": q_threshold_table,
        "roc_auc": q_roc_auc,
        "fit_logistic": _fit_query("logistic_regression"),
        "fit_tree": _fit_query("decision_tree"),
        "fit_gbt": _fit_query("gradient_boosting"),
        "feature_importance": q_feature_importance,
        "save_reload": q_save_reload,
        "model_report": q_model_report,
        "save_merge": q_save_merge,
        "save_interrupted": q_save_interrupted,
        "spine_repeated_students": q_spine_repeated_students,
        "payment_order_without_dates": q_payment_order_without_dates,
        "roc_auc_gaps": q_roc_auc_gaps,
        "prediction_flags_gaps": q_prediction_flags_gaps,
        "fit_logistic_rule": _fit_rule_query("logistic_regression"),
        "fit_tree_rule": _fit_rule_query("decision_tree"),
        "fit_gbt_rule": _fit_rule_query("gradient_boosting"),
        "feature_importance_rule": q_feature_importance_rule,
        "feature_importance_boosted_rule": q_feature_importance_boosted_rule,
        "feature_importance_two_columns": q_feature_importance_two_columns,
        "tree_probability": q_tree_probability,
        "logistic_optimality": q_logistic_optimality,
    }


def all_queries() -> dict[str, Query]:
    return {**relational_queries(), **model_queries()}


__all__ = ["FIXTURE", "relational_queries", "model_queries", "all_queries"]
