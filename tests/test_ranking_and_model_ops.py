"""Exact ranking, split stability, balancing and metric edge cases."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.operators import encode, evaluate, prepare
from attrition.operators.ranking import exact_row_number
from attrition.sources.tables import read_table, save_training_table
from attrition.session import scratch_path


def test_exact_row_number_matches_window_on_skewed_groups(spark):
    rnd = random.Random(7)
    # group 0 holds about a third of the rows; order keys have ties broken by id.
    rows = [(0 if rnd.random() < 0.34 else rnd.randint(1, 40), rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = exact_row_number(df, ["g"], [F.col("o"), F.col("id")], num_partitions=7)
    want = df.withColumn("row_number", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert sorted(map(tuple, got.select("g", "o", "id", "row_number").collect())) == sorted(
        map(tuple, want.select("g", "o", "id", "row_number").collect())
    )


def test_split_is_stable_under_repartition(spark):
    df = spark.range(2000).withColumnRenamed("id", "student_id")
    a = prepare.with_split(df.repartition(1)).where("is_test").count()
    b = prepare.with_split(df.repartition(13)).where("is_test").count()
    assert a == b and 0.25 < a / 2000 < 0.41


def _train(spark, pos: int, neg: int):
    rows = [(i, 7, i < pos) for i in range(pos + neg)]
    return spark.createDataFrame(rows, "student_id long, days_since_first_sub_payment int, churn_day_33 boolean")


def test_balance_takes_exactly_n_pos_negatives(spark):
    out = prepare.balance(_train(spark, 30, 200))
    counts = {r.churn_day_33: r["count"] for r in out.groupBy("churn_day_33").count().collect()}
    assert counts == {True: 30, False: 30}


def test_balance_with_fewer_negatives_keeps_them_all(spark):
    out = prepare.balance(_train(spark, 50, 20))  # E17
    counts = {r.churn_day_33: r["count"] for r in out.groupBy("churn_day_33").count().collect()}
    assert counts == {True: 50, False: 20}


def test_precision_zero_without_predicted_positives(spark):
    pred = spark.createDataFrame(
        [(7, "m", 1, True, False, 0.1), (7, "m", 2, False, False, 0.2)],
        "horizon int, model string, student_id long, label boolean, prediction boolean, p_churn double",
    )
    m = evaluate.model_metrics(pred, compat=True).collect()[0]
    assert m.precision == 0.0 and m.recall == 0.0  # E16
    assert m.ref_roc_auc_score is None  # no predicted positives: undefined
    t = {r.threshold: r for r in evaluate.threshold_metrics(pred).collect()}
    assert t[0.9].precision == 0.0


def test_roc_auc_with_ties(spark):
    pred = spark.createDataFrame(
        [(7, "m", 1, True, True, 0.8), (7, "m", 2, False, True, 0.8), (7, "m", 3, False, False, 0.1),
         (7, "m", 4, True, True, 0.9)],
        "horizon int, model string, student_id long, label boolean, prediction boolean, p_churn double",
    )
    auc = evaluate.roc_auc(pred).collect()[0].roc_auc
    # pairs (pos, neg): (0.8,0.8)=0.5, (0.8,0.1)=1, (0.9,0.8)=1, (0.9,0.1)=1 -> 3.5/4
    assert auc == 0.875


def test_unseen_category_encodes_to_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("zzz",)], "c string")
    enc = encode.encoder(categoricals=["c"], columns=["c"]).fit(train)
    vecs = [r.features.toArray().tolist() for r in enc.transform(test).orderBy("c").collect()]
    assert vecs == [[1.0, 0.0], [0.0, 0.0]]  # E15
    assert encode.feature_names(enc.transform(test)) == ["c=a", "c=b"]


def test_read_table_precedence(spark):
    spark.range(5).createOrReplaceTempView("t_prec")
    assert read_table(spark, "t_prec").count() == 5
    assert read_table(spark, "t_prec", condition="id > 2").count() == 2
    assert read_table(spark, "t_prec", condition="id > 2", query="SELECT 1 AS x").columns == ["x"]  # E18
    try:
        read_table(spark, condition="id > 2")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_read_table_sends_statement_to_external_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class EchoReader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def read(self, partition):
            yield (self.options.get("query"), self.options.get("user"))

    class EchoSource(DataSource):
        @classmethod
        def name(cls):
            return "echo_query"

        def schema(self):
            return "query string, user string"

        def reader(self, schema):
            return EchoReader(self.options)

    spark.dataSource.register(EchoSource)
    opts = {"user": "u"}
    whole = read_table(spark, "db.t", fmt="echo_query", options=opts).collect()[0]
    assert (whole.query, whole.user) == ("select * from db.t", "u")
    filtered = read_table(spark, "db.t", condition="x > 1", fmt="echo_query", options=opts).collect()[0]
    assert filtered.query == "select * from db.t WHERE x > 1"
    q = read_table(spark, "db.t", condition="x > 1", query="select 1", fmt="echo_query").collect()[0]
    assert q.query == "select 1"


def test_overwrite_merges_schema(spark):
    name = "merge_probe"
    path = scratch_path(spark, name)
    save_training_table(spark.createDataFrame([(1, "a")], "id long, a string"), name, path=path)
    save_training_table(spark.createDataFrame([(2, "b")], "id long, b string"), name, path=path)  # E19
    out = spark.table(name)
    assert out.columns == ["id", "b", "a"]
    assert [tuple(r) for r in out.collect()] == [(2, "b", None)]


def test_failed_overwrite_keeps_the_old_table(spark):
    name = "staged_probe"
    path = scratch_path(spark, name)
    save_training_table(spark.range(5), name, path=path)
    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    for kw in ({"path": path}, {}):
        with pytest.raises(Exception, match="no"):
            save_training_table(broken, name, **kw)
        assert spark.table(name).count() == 5
    save_training_table(spark.range(2), name, path=path)
    assert spark.table(name).count() == 2


def test_type_conflict_is_refused(spark):
    name = "conflict_probe"
    path = scratch_path(spark, name)
    save_training_table(spark.createDataFrame([("a",)], "a string"), name, path=path)
    with pytest.raises(ValueError, match="a: stored string, new int"):
        save_training_table(spark.createDataFrame([(1,)], "a int"), name, path=path)
    assert spark.table(name).first().a == "a"


def test_null_order_dates_and_buckets_are_numbered(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5, 2), (1, None, 3), (2, None, 4)], "g int, o int, id int")
    got = exact_row_number(df, ["g"], ["o", "id"], bucket=F.col("o"))
    assert sorted((r.id, r.row_number) for r in got.collect()) == [(1, 1), (2, 3), (3, 2), (4, 1)]


def test_scores_outside_zero_one_null_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    scores = [(True, nan), (False, 0.2), (True, inf), (False, -inf), (True, 7.5), (False, 7.25), (False, -3.0), (True, -2.5), (True, None), (False, None), (True, 1.0)]
    pred = spark.createDataFrame([(7, "m", y, s) for y, s in scores], "horizon int, model string, label boolean, p_churn double")
    rank = lambda s: (1, 0.0) if s != s else (0, s)
    pos, neg = ([rank(s) for y, s in scores if y is w and s is not None] for w in (True, False))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    r = evaluate.roc_auc(pred).first()
    assert (r.roc_auc, r.n_unscored) == (want, 2)
    flags = evaluate.with_threshold_flags(pred, (0.85, 0.851)).collect()
    assert [(f.thr_85, f.thr_85_1) for f in flags] == [(s is not None and s == s and s >= 0.85, s is not None and s == s and s >= 0.851) for _, s in scores]
    two = evaluate.threshold_metrics(pred, (0.85, 0.851)).collect()
    assert [t.threshold for t in two] == [0.85, 0.851]


def test_repeated_student_keeps_all_dates(spark):
    from attrition.operators.spine import build_spine
    from tests.conftest import SCHEMAS, D, T

    students = [(1, T("2024-01-01 08:00:00"), T(f"2024-01-{d:02d} 09:00:00"), "DE", "X", "EU", 1.0, "lv1", False) for d in (1, 5)]
    dates = spark.createDataFrame([(D(f"2024-01-{d:02d}"),) for d in range(1, 32)], SCHEMAS["dim_date"])
    spine = build_spine(spark.createDataFrame(students, SCHEMAS["dim_student"]), dates, "2024-01-01", "2024-02-01", 5).collect()
    assert sorted(r.date_dt for r in spine) == [D(f"2024-01-{d:02d}") for d in range(1, 11)]
