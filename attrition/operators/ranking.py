"""Exact row numbers inside groups without one task per group.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to
one task; with one group holding a third of the data that task holds a third
of the data. Here the rows are range-partitioned on (g, o) instead, so a big
group is spread over several partitions in order. Each partition numbers its
rows by position (``monotonically_increasing_id`` after a local sort), and the
rows of the same group in earlier partitions are added from a small table of
per-(partition, group) counts. That table has at most
#groups + #partitions rows and each group appears in it at most #partitions
times, so the prefix sum over it is bounded as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.session import ensure_checkpoint_dir


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_row_number(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    out: str = "row_number",
    num_partitions: int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group by ``order_cols``.

    Ties in ``order_cols`` are numbered in an arbitrary order, as with
    ``row_number``; pass a unique tie-break for reproducible numbers.

    ``bucket``: an integer expression that never decreases along
    ``order_cols`` and spreads rows evenly (e.g. leading digits of a hash the
    rows are ordered by). Rows are then numbered inside (group, bucket) and
    shifted by the sizes of the earlier buckets; no sampling pass is needed.
    Without it the rows are range-partitioned, which samples the input first.
    """
    if bucket is not None:
        return running_sum(df, group_cols, order_cols, F.lit(1), out, bucket)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + [_as_col(o) for o in order_cols]
    # Positions are written once to the shared checkpoint folder: the count
    # table and the numbered rows then read the same (partition, position)
    # values, even if a recomputation would sample other range bounds.
    ensure_checkpoint_dir(spark)
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    runs = ranged.groupBy("_part", *group_cols).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        F.col("_part").alias("_rpart"),
        *[F.col(g).alias(f"_r_{g}") for g in group_cols],
        "_first",
        "_before",
    )
    cond = reduce(
        lambda a, b: a & b,
        [F.col("_part") == F.col("_rpart")] + [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group_cols],
    )
    joined = ranged.join(runs, cond, "inner")
    return joined.withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before") + F.lit(1)).drop(
        "_pos", "_part", "_rpart", "_first", "_before", *[f"_r_{g}" for g in group_cols]
    )


def running_sum(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    weight: Column,
    out: str,
    bucket: Column,
) -> DataFrame:
    """``sum(weight) OVER (PARTITION BY g ORDER BY o ROWS UNBOUNDED PRECEDING)``
    computed per (group, bucket) and shifted by the totals of earlier buckets.

    ``bucket`` must never decrease along ``order_cols``; a null bucket comes first, as
    null order values do. A task holds one
    (group, bucket) slice; the offset table has one row per (group, bucket).
    With weight 1 this is ``row_number``.
    """
    group_cols = list(group_cols)
    b = df.withColumn("_bucket", bucket).withColumn("_w", weight)
    local = (
        Window.partitionBy(*group_cols, "_bucket")
        .orderBy(*[_as_col(o) for o in order_cols])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = b.withColumn("_local", F.sum("_w").over(local))
    sizes = b.groupBy(*group_cols, "_bucket").agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *[F.col(g).alias(f"_r_{g}") for g in group_cols], F.col("_bucket").alias("_rbucket"), "_before"
    )
    cond = reduce(
        lambda a, c: a & c,
        [F.col("_bucket").eqNullSafe(F.col("_rbucket"))] + [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group_cols],
    )
    return (
        numbered.join(offsets, cond, "inner")
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_bucket", "_rbucket", "_local", "_before", "_w", *[f"_r_{g}" for g in group_cols])
    )
