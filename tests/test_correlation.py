"""M1: co-moments in one pass."""

from __future__ import annotations

import numpy as np
import pytest

from attrition.operators import stats


def matrix(df, cols):
    got = {(r.feature_a, r.feature_b): r["corr"] for r in stats.correlation_matrix(df, cols).collect()}
    return [[got[a, b] for b in cols] for a in cols]


def jobs_of(spark, run) -> int:
    group = f"corr-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equals_numpy_and_takes_one_job(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * [1, 50, 1e-3, 1e5] + [3, -40, 0, 1e5]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(5).checkpoint()
    want = np.corrcoef(x.T).round(6)
    assert np.abs(np.array(matrix(df, list("abcd"))) - want).max() <= 1e-6
    assert jobs_of(spark, lambda: stats.correlation_matrix(df, list("abcd"))) == 1


def test_values_close_together_take_a_second_pass(spark):
    rng = np.random.default_rng(2)
    near = rng.normal(size=300)
    rows = [(1e9 + float(v) * 1e-2, float(v) + float(w), bool(v > 0)) for v, w in zip(near, rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y boolean").checkpoint()
    want = np.corrcoef(np.array(rows, float).T).round(6)
    assert np.abs(np.array(matrix(df, ["a", "b", "y"])) - want).max() <= 2e-6
    assert jobs_of(spark, lambda: stats.correlation_matrix(df, ["a", "b", "y"])) == 2


def test_constant_columns_and_empty_frames(spark):
    df = spark.createDataFrame([(0.1, 0.0, float(i)) for i in range(37)], "a double, b double, c double")
    assert matrix(df, ["a", "b", "c"]) == [[None] * 3, [None] * 3, [None, None, 1.0]]
    assert matrix(df.limit(0), ["a", "c"]) == [[None, None], [None, None]]
    with pytest.raises(Exception, match="null"):
        matrix(spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double"), ["a", "b"])
