"""Training-frame selection, null filling, split and class balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import (
    CATEGORICAL_FEATURES,
    CATEGORICAL_FILL,
    HORIZON_COL,
    HORIZONS,
    LABEL,
    MODEL_COLUMNS,
    NUMERIC_FEATURES,
    SPLIT_SEED,
    TEST_PERCENT,
)
from attrition.sources.tables import training_rows


def model_frame(training: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows on horizon days with an active subscription; the 30 model
    columns (numerics null -> 0.0 as double, categoricals null -> 'empty'),
    the label, and student_id to identify rows."""
    rows = training_rows(training, horizons)
    out: list[Column] = [F.col("student_id")]
    for c in MODEL_COLUMNS:
        if c in NUMERIC_FEATURES:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        elif c in CATEGORICAL_FEATURES:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit(CATEGORICAL_FILL)).alias(c))
        else:
            out.append(F.col(c))
    out.append(F.col(LABEL))
    return rows.select(*out)


def split_bucket(seed: int = SPLIT_SEED, key: str = "student_id") -> Column:
    """0..99 from the first 7 hex digits of md5('<seed>:<key>')."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % 100


def test_flag(seed: int = SPLIT_SEED, test_percent: int = TEST_PERCENT, key: str = "student_id") -> Column:
    """M2: a row is in the test set when its bucket is below ``test_percent``.

    Depends only on the key, never on partitioning or row order, so it is
    stable across reruns and executor loss (``randomSplit`` is not).
    """
    return split_bucket(seed, key) < F.lit(test_percent)


def with_split(df: DataFrame, seed: int = SPLIT_SEED, test_percent: int = TEST_PERCENT) -> DataFrame:
    return df.withColumn("is_test", test_flag(seed, test_percent))


def sample_key(seed: int = SPLIT_SEED, group_col: str = HORIZON_COL, key: str = "student_id") -> Column:
    """Pseudo-random order used to draw the majority-class rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group_col).cast("string"), F.col(key).cast("string")))


def class_counts(train: DataFrame, group_col: str = HORIZON_COL, label: str = LABEL) -> DataFrame:
    """Positives and negatives per group (one row per horizon)."""
    y = F.col(label)
    return train.groupBy(group_col).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("bigint").alias("n_pos"),
        F.sum(F.when(~y, 1).otherwise(0)).cast("bigint").alias("n_neg"),
    )


def balance(
    train: DataFrame,
    group_col: str = HORIZON_COL,
    label: str = LABEL,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """M3: all positive (churned) rows plus as many negative rows, per group.

    Negatives are drawn without replacement in md5 order of (seed, group,
    student): exactly min(n_pos, n_neg) of them; when they are fewer than the
    positives all are kept (the reference fails then). Rows that tie on group and
    student are drawn together.

    A histogram of the md5 order (65,536 buckets a group) gives the bucket in
    which the draw ends; inside it the last drawn key is looked up. Both are one
    row a group and broadcast, so the rows themselves are only filtered, never
    shuffled or ranked.
    """
    y = F.col(label)
    key = F.concat(sample_key(seed, group_col), F.lit(":"), F.col("student_id").cast("string"))
    bucket = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    lean = train.select(F.col(group_col).alias("_g"), y.alias("_y"), key.alias("_key"), bucket.alias("_bucket"))
    histogram = lean.groupBy("_g", "_bucket").agg(F.count(F.when(~F.col("_y"), 1)).alias("_n"), F.count(F.when(F.col("_y"), 1)).alias("_p"))
    whole = Window.partitionBy("_g")  # at most 65,536 rows a group
    through = F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = histogram.select("_g", "_bucket", "_n", F.least(F.sum("_p").over(whole), F.sum("_n").over(whole)).alias("_keep"), through.alias("_through"))
    cut = ends.where((F.col("_through") >= F.col("_keep")) & (F.col("_through") - F.col("_n") < F.col("_keep")))
    cut = cut.select(F.col("_g").alias("_cg"), F.col("_bucket").alias("_cut"), (F.col("_keep") - F.col("_through") + F.col("_n")).alias("_rest"))
    inside = lean.where(~F.col("_y")).join(F.broadcast(cut), (F.col("_g") == F.col("_cg")) & (F.col("_bucket") == F.col("_cut")))
    order = Window.partitionBy("_g").orderBy("_key")  # one bucket's rows of a group
    last = inside.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_rest")).select("_cg", "_cut", F.col("_key").alias("_last"))
    drawn = train.join(F.broadcast(last), F.col(group_col) == F.col("_cg"), "left")
    taken = F.coalesce((bucket < F.col("_cut")) | ((bucket == F.col("_cut")) & (key <= F.col("_last"))), F.lit(False))
    return drawn.where(y | taken).select(*train.columns)
