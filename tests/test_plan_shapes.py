"""Physical-plan properties the design relies on at scale."""

from __future__ import annotations

import re

import pytest

from attrition.operators import prepare
from attrition.plans import training_table as tt
from attrition.plans.registry import FIXTURE, all_queries, sources
from tests.conftest import SF_SMALL


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def src(spark):
    return sources(spark, SF_SMALL)


def test_training_plan_has_no_cross_join_or_python(src):
    plan = plan_text(tt.build_training_table(src, FIXTURE))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_daily_facts_combine_before_the_shuffle(src):
    plan = plan_text(tt.daily_facts(src, ("sessions", "search"), tt.cohort_frames(src, FIXTURE), FIXTURE))
    # partial aggregate -> exchange -> final aggregate
    assert "partial_sum" in plan and "Exchange hashpartitioning" in plan


def test_registered_training_table_prunes_and_aggregates_once(spark):
    df = all_queries()["training_table"](spark, SF_SMALL)
    text = formatted(df)
    scans = [part for part in text.split("\n\n") if "Scan parquet" in part and "events.parquet" in part]
    assert scans and not any("InMemoryTableScan" in line for line in text.splitlines())
    dated = [p for p in scans if "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p]
    assert len(dated) >= 4
    for p in scans:
        assert "event_id,ts,user_id,event_type,value,props" not in p.replace(":", ",")
    assert not any("value" in p.split("ReadSchema")[1] for p in scans if "search" in p)
    shuffles = [line for line in plan_text(df).splitlines() if re.search(r"(?<!Broadcast)Exchange \w+", line)]
    assert len(shuffles) <= 13, "\n".join(x[:120] for x in shuffles)


def test_balancing_never_shuffles_the_rows(spark):
    rows = [(i, 7, i % 3 == 0, float(i)) for i in range(300)]
    train = spark.createDataFrame(rows, "student_id long, days_since_first_sub_payment int, churn_day_33 boolean, wide double")
    plan = plan_text(prepare.balance(train))
    for line in plan.splitlines():
        if re.search(r"(Exchange|Window|Sort) ", line) and "Broadcast" not in line:
            assert "wide" not in line
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
