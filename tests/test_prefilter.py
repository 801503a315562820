"""Membership filter, lesson masks and co-partitioned plans."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from attrition.config import ChurnConfig
from attrition.operators import facts, prefilter
from attrition.plans import bucketed
from attrition.plans import training_table as tt
from attrition.plans.jobs import prepare_job, publish_job
from attrition.plans.registry import FIXTURE, all_queries, sources
from attrition.session import scratch_path
from attrition.sources.bundle import ChurnSources
from tests.conftest import SF_SMALL, D, T, log, student
from tests.test_plan_shapes import plan_text


def test_members_always_pass_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    held = prefilter.members(keys, "k", 20_000)
    rows = spark.range(40_000).select(F.col("id").cast("int").alias("u"), F.lit(1).alias("word"), F.lit(2).alias("bits"))
    got = held.keep(rows, "u")
    assert got.columns == ["u", "word", "bits"]
    assert got.where("u % 2 = 0").count() == 20_000
    assert got.where("u % 2 = 1").count() < 20_000 / 50
    told = held.flag(rows, "u", "inside")
    assert told.columns == ["u", "word", "bits", "inside"] and told.count() == 40_000
    assert told.where("inside").count() == got.count()


def test_filter_of_texts_nulls_and_empty_sets(spark):
    names = spark.createDataFrame([("a",), (None,), ("b",)], "s string")
    held = prefilter.members(names, "s", 3)
    rows = spark.createDataFrame([("a",), (None,), ("zz",)], "s string")
    assert [r.s for r in held.keep(rows, "s").collect()] == ["a"]
    assert prefilter.members(names.limit(0), "s", 0).keep(rows, "s").count() == 0
    assert prefilter.members(names, "s", prefilter.MAX_KEYS + 1) is None
    assert prefilter.keep_members(None, rows, "s").count() == 3
    assert prefilter.words_for(prefilter.MAX_KEYS) == prefilter.MAX_WORDS and prefilter.words_for(0) == 64


@pytest.fixture(scope="module")
def stored(spark):
    """The role sources as plain tables, so that plans end at scans of the facts."""
    src = sources(spark, SF_SMALL)
    out = {}
    for name in ChurnSources.__dataclass_fields__:
        path = scratch_path(spark, f"role-{name}")
        getattr(src, name).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return ChurnSources(**out)


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def above(lines: list[str], at: int) -> list[str]:
    """The line's ancestors in the tree, nearest first."""
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            out.append(line)
            level = depth(line)
    return out


def test_filter_stands_below_the_first_aggregate_of_every_fact(stored):
    frames = tt.cohort_frames(stored, FIXTURE)
    lines = plan_text(tt.daily_facts(stored, ("sessions", "lessons", "messages", "search", "status"), frames, FIXTURE)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert len(scans) == 6  # one of each source, and the threads
    for i in scans:
        up = above(lines, i)
        first = next(k for k, line in enumerate(up) if re.search(r"Aggregate|Exchange hashpartitioning|SortMergeJoin", line))
        assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in up[:first]), "\n".join(up)


def test_hot_user_outside_the_cohort_shuffles_no_row(spark, make_sources):
    hot = 999
    src = make_sources(
        dim_student=[student(1), student(hot)],
        subscription_logs=[log(1, 10, "2024-01-02"), log(hot, 11, "2024-01-02"), log(hot, 12, "2024-01-02")],
        sessions=[(hot, T("2024-01-03 10:00:00"), 1, 1, None)] * 500 + [(1, T("2024-01-03 10:00:00"), 2, 5, None)],
        lessons=[(i, hot, T("2024-01-03 10:00:00"), "COMPLETED", None) for i in range(200)],
        message_threads=[(5, hot, 70), (6, 1, 71)],
        messages=[(5, hot, T("2024-01-03 10:00:00"))] * 300 + [(6, 1, T("2024-01-03 10:00:00"))],
        events=[(hot, T("2024-01-03 10:00:00"), "search_completed")] * 300,
    )
    cfg = ChurnConfig(label_day=5)
    frames = tt.cohort_frames(src, cfg)
    daily = tt.daily_facts(src, ("sessions", "lessons", "messages", "search", "status"), frames, cfg)
    assert {r.student_id for r in daily.collect()} == {1}
    last = tt.build_training_table(src, cfg).where("date_dt = '2024-01-06'").first()
    assert (last.sum_pages_viewed_all, last.student_messages_sent) == (2, 1)


def brute_new_lessons(rows, first_sub: dt.date, day: dt.date) -> int:
    return len({i for i, ts in rows if i is not None and first_sub <= ts <= day})


@pytest.mark.parametrize("label_day", [1, 5, 24, 33, 62, 63, 90])
def test_distinct_lessons_from_day_masks(spark, make_sources, label_day):
    rng = random.Random(label_day)
    first = D("2023-12-25")  # blocks of days begin before and after it
    begin = dt.date(2023, 9, 1)
    rows = [(rng.choice([None, *range(12)]), begin + dt.timedelta(days=rng.randrange(240))) for _ in range(150)]
    rows += [(77, first + dt.timedelta(days=k)) for k in range(0, label_day, 3)]
    lessons = [(i, 1, T(f"{d} 10:00:00"), "COMPLETED", rng.choice([None, 4.0])) for i, d in rows]
    lessons += [(500, 1, T(f"{first} 11:00:00"), "CANCELLED", 5.0), (501, 1, None, "COMPLETED", 5.0)]
    src = make_sources(
        dim_date=[(first + dt.timedelta(days=i),) for i in range(label_day + 3)],
        dim_student=[student(1, first_pay=f"{first} 08:00:00", first_sub=f"{first} 08:00:00")],
        subscription_logs=[log(1, 10, str(first), first_sub=f"{first} 08:00:00")],
        lessons=lessons,
    )
    got = {r.date_dt: r for r in tt.feature_frame(src, ("lessons",), ChurnConfig(label_day=label_day)).collect()}
    assert len(got) == label_day + 1
    for k in range(label_day + 1):
        day = first + dt.timedelta(days=k)
        inside = [(i, d) for i, d in rows if first <= d <= day]
        assert got[day].num_confirmed_lessons_during_sub == brute_new_lessons(rows, first, day)
        assert got[day].last_confirmed_lesson_date == max((d for _, d in inside), default=None)


def test_lessons_are_scanned_and_aggregated_once(stored):
    lines = plan_text(facts.daily(facts.lesson_rows(stored.lessons, 33), ["lessons"])).splitlines()
    assert sum("FileScan" in line for line in lines) == 1
    assert not any("collect_set" in line or "ObjectHashAggregate" in line for line in lines)


def test_bucketed_tables_join_and_window_without_a_shuffle(spark):
    df = all_queries()["training_table_bucketed"](spark, SF_SMALL)
    lines = plan_text(df).splitlines()
    shuffles = [line for line in lines if re.search(r"(?<!Broadcast)Exchange \w+", line)]
    assert len(shuffles) <= 1, "\n".join(x[:160] for x in shuffles)  # the calendar's
    assert any("Window" in line for line in lines) and not any("CartesianProduct" in line for line in lines)
    cols = df.columns
    assert sorted(map(str, df.collect())) == sorted(map(str, all_queries()["training_table"](spark, SF_SMALL).select(cols).collect()))


def test_published_tables_feed_the_prepare_job(spark):
    sources(spark, SF_SMALL).register()
    tables = publish_job(spark, "pub_probe", scratch_path(spark, "pub"), 3, cfg=FIXTURE)
    prepare_job(spark, "pub_training", cfg=FIXTURE, path=scratch_path(spark, "pub-out"), published="pub_probe")
    assert spark.table("pub_training").count() == 275 and tables.label_day(spark) == FIXTURE.label_day
    with pytest.raises(ValueError, match="label day 24, not 30"):
        bucketed.build(spark, tables, ChurnConfig(label_day=30))
