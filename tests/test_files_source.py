"""S2 outside the catalog: what the source takes over, and the same rows as Spark."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import datasource as api

from attrition.session import scratch_path
from attrition.sources import files_source
from attrition.sources.tables import read_table
from tests.test_plan_shapes import plan_text


@pytest.fixture(scope="module")
def root(spark):
    path = scratch_path(spark, "files-source")
    day = dt.date(2024, 1, 1)
    rows = [(i, f"n{i % 5}" if i % 7 else None, float("nan") if i % 11 == 0 else i / 3, day + dt.timedelta(days=i % 9), i % 2 == 0) for i in range(200)]
    spark.createDataFrame(rows, "i long, s string, x double, d date, b boolean").repartition(3).write.parquet(f"{path}/t.parquet")
    return path


CONDITIONS = [
    "i > 150",
    "i >= 20 AND i < 40 AND s = 'n3'",
    "s IN ('n1', 'n2', NULL) AND b",
    "NOT (s IN ('n1', 'n2'))",
    "s <> 'n3' AND s IS NOT NULL",
    "s IS NULL",
    "x > 20",
    "d = DATE'2024-01-03' OR i = 7",
    "d <= DATE'2024-01-02' AND length(s) = 2",
    "s <=> NULL",
    "s LIKE 'n%' AND i <= 12",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_rows_equal_sparks_own(spark, root, condition):
    got = read_table(spark, "t", condition=condition, fmt=files_source.FORMAT, options={"root": root})
    want = spark.read.parquet(f"{root}/t.parquet").where(condition)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_filters_are_seen_at_the_source(spark, root):
    schema = spark.read.parquet(f"{root}/t.parquet").schema
    reader = files_source.FilesReader(schema, root, "t")
    mine = [api.GreaterThan(("i",), 150), api.IsNotNull(("s",)), api.Not(api.EqualTo(("s",), "n3"))]
    left = [api.GreaterThan(("x",), 2.0), api.StringContains(("s",), "n"), api.EqualTo(("no",), 1)]
    assert list(reader.pushFilters([*mine, *left])) == left and reader.taken == mine
    sent = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sent and all(r["i"] > 150 and r["s"] not in (None, "n3") for r in sent)
    df = read_table(spark, "t", condition="i > 150 AND x > 20", fmt=files_source.FORMAT, options={"root": root, "columns": "i,x"})
    kept = [line for line in plan_text(df).splitlines() if "Filter (" in line]  # what Spark still has to do
    assert len(kept) == 1 and "20.0" in kept[0] and "150" not in kept[0]
    assert df.columns == ["i", "x"]


def test_a_partition_is_a_file(spark, root):
    df = read_table(spark, "t", fmt=files_source.FORMAT, options={"root": root})
    assert df.rdd.getNumPartitions() == 3 and df.count() == 200


def test_options_are_checked(spark, root):
    with pytest.raises(Exception, match="needs the option 'root'"):
        read_table(spark, "t", fmt=files_source.FORMAT)
    with pytest.raises(ValueError, match="no query"):
        read_table(spark, query="select 1", fmt=files_source.FORMAT, options={"root": root})
