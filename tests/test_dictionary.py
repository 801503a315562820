"""The encoder's level dictionary: slots, joins at any size, models on its vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attrition.config import HORIZON_COL, LABEL
from attrition.operators import dictionary, encode, models
from tests.test_plan_shapes import plan_text


def rows(spark):
    data = [("b", "x", 1.0), ("a", "x", 0.0), ("a", None, 2.0), ("é", "y", 0.5), ("a=b", "empty", 0.0)]
    return spark.createDataFrame(data, "c string, d string, v double")


@pytest.mark.parametrize("limit", [dictionary.BROADCAST_LEVELS, 0])
def test_vectors_and_cells(spark, monkeypatch, limit):
    monkeypatch.setattr(dictionary, "BROADCAST_LEVELS", limit)
    enc = dictionary.fit_levels(rows(spark), ["c", "d"], ["v", "c", "d"])
    assert enc.sizes == {"c": 4, "d": 3} and enc.rest == ("v",) and enc.width == 8
    names = [r.feature for r in enc.features().orderBy("slot").collect()]
    assert names == ["c=a", "c=a=b", "c=b", "c=é", "d=empty", "d=x", "d=y", "v"]
    test = spark.createDataFrame([(1, "a", "y", 3.0), (2, "zz", None, 0.0), (3, None, "x", -1.0), (4, "é", "x", 0.0)], "id int, c string, d string, v double")
    got = {r.id: r.features.toArray().tolist() for r in enc.transform(test).collect()}
    assert got == {1: [1, 0, 0, 0, 0, 0, 1, 3], 2: [0] * 8, 3: [0, 0, 0, 0, 0, 1, 0, -1], 4: [0, 0, 0, 1, 0, 1, 0, 0]}
    cells = sorted(tuple(r) for r in enc.explode(test, ["id"]).collect())
    assert cells == [(1, "c=a", 1.0), (1, "d=y", 1.0), (1, "v", 3.0), (3, "d=x", 1.0), (3, "v", -1.0), (4, "c=é", 1.0), (4, "d=x", 1.0)]


def test_equals_the_pipeline_encoder(spark):
    train = rows(spark).na.fill("empty")
    old = encode.encoder(["c", "d"], ["c", "d", "v"]).fit(train).transform(train)
    enc = dictionary.fit_levels(train, ["c", "d"], ["c", "d", "v"])
    assert [r.feature for r in enc.features().orderBy("slot").collect()] == encode.feature_names(old)
    assert sorted(str(r.features.toArray()) for r in old.collect()) == sorted(str(r.features.toArray()) for r in enc.transform(train).collect())


def test_a_million_levels_stay_distributed(spark):
    n = 1_000_000
    train = spark.range(n + n // 2).select(
        F.when(F.col("id") < n, F.concat(F.lit("L"), F.lpad(F.col("id").cast("string"), 7, "0"))).otherwise(F.lit("L0000005")).alias("c"),
        F.lit(1.0).alias("v"),
        "id",
    )
    enc = dictionary.fit_levels(train, ["c"], ["c", "v"])
    assert enc.sizes == {"c": n}
    placed = enc.with_positions(train)
    plan = plan_text(placed)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    wrong = placed.where(F.col("c__at") != F.substring("c", 2, 7).cast("long")).count()
    assert wrong == 0 and placed.where("c__at IS NULL").count() == 0
    # the level that a third of the rows have is spread over the tasks of the shuffle
    spread = placed.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().toPandas()["count"]
    assert spread.max() < 2 * spread.mean()
    vector = enc.transform(train.limit(3)).first().features
    assert vector.size == n + 1 and len(vector.indices) == 2


def test_empty_columns_and_tables(spark):
    some = spark.createDataFrame([(None, 1.0)], "c string, v double")
    enc = dictionary.fit_levels(some, ["c"], ["c", "v"])
    assert enc.sizes == {"c": 0} and enc.transform(some).first().features.toArray().tolist() == [1.0]
    assert dictionary.fit_levels(some.limit(0), ["c"], ["c", "v"]).transform(some.limit(0)).count() == 0


def test_certificate_sees_weights_that_are_not_the_minimum(spark):
    data = [(7, i % 3 != 0, f"l{i % 4}", float(i % 7)) for i in range(80)]
    train = spark.createDataFrame(data, f"{HORIZON_COL} int, {LABEL} boolean, c string, v double")
    good = models.fit_all(train, (7,), ("logistic_regression",), categoricals=["c"], columns=["c", "v"])
    told = models.optimality(good, train).collect()
    assert {r.feature_name for r in told} == {"c=l0", "c=l1", "c=l2", "c=l3", "v", models.INTERCEPT}
    assert all(r.within_bound for r in told)
    lazy = models.ChurnConfig(logreg_tol=0.5)
    bad = models.fit_all(train, (7,), ("logistic_regression",), lazy, categoricals=["c"], columns=["c", "v"])
    assert not all(r.within_bound for r in models.optimality(bad, train).collect())
