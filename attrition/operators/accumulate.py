"""Cumulative feature computation: union + one running window per student.

The spine rows and the in-window daily facts of every source are stacked
(``unionByName``) and ordered by day inside each student. A RANGE frame
"unbounded preceding .. current row" over the day includes all facts dated on
or before the spine date, i.e. exactly the reference's interval join
``first_sub <= fact_date <= date_dt`` (facts before first_sub were dropped by
``facts.within_window``). Same-day and whole-student frames give the status
and label. One shuffle on student_id feeds the window; each student holds at
most (label_day + 1) rows per source, so no task grows with a hot student.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import SPINE_COLUMNS
from attrition.functions.labels import churn_from_active
from attrition.functions.ratios import safe_ratio
from attrition.operators.facts import DAY

ALL_GROUPS = ("status", "lessons", "sessions", "messages", "payment", "search")

def _frame(lo: int, hi: int):
    """Frames over one student's rows of one first subscription, ordered by day
    (built lazily: a window spec needs an active session)."""
    return Window.partitionBy("student_id", "_fs").orderBy(DAY).rangeBetween(lo, hi)


def running():
    return _frame(Window.unboundedPreceding, Window.currentRow)


def same_day():
    return _frame(Window.currentRow, Window.currentRow)


def whole():
    return _frame(Window.unboundedPreceding, Window.unboundedFollowing)


def _run_sum(c: str) -> Column:
    return F.sum(c).over(running())


def _count0(c: str) -> Column:
    return F.coalesce(_run_sum(c), F.lit(0).cast("bigint"))


def _avg(prefix: str) -> Column:
    return safe_ratio(_run_sum(f"{prefix}_sum"), _run_sum(f"{prefix}_n"))


def _group_exprs(group: str) -> list[Column]:
    date = F.col("date_dt")
    if group == "sessions":
        last = F.max(F.when(F.col("ses_day") == 1, F.col(DAY))).over(running())
        return [
            _run_sum("ses_pages_sum").alias("sum_pages_viewed_all"),
            _avg("ses_pages").alias("avg_pages_viewed_all"),
            _count0("ses_day").alias("days_with_session"),
            _run_sum("ses_dur_sum").alias("sum_session_duration_all"),
            _avg("ses_dur").alias("avg_session_duration_all"),
            _run_sum("ses_app_pages_sum").alias("sum_page_viewed_app"),
            _avg("ses_app_pages").alias("avg_page_viewed_app"),
            _run_sum("ses_app_dur_sum").alias("sum_session_duration_app"),
            _avg("ses_app_dur").alias("avg_session_duration_app"),
            _run_sum("ses_web_pages_sum").alias("sum_page_viewed_non_app"),
            _avg("ses_web_pages").alias("avg_page_viewed_non_app"),
            _run_sum("ses_web_dur_sum").alias("sum_session_duration_non_app"),
            _avg("ses_web_dur").alias("avg_session_duration_non_app"),
            F.datediff(date, last).alias("days_since_last_session"),
        ]
    if group == "lessons":
        last = F.max(F.when(F.col("les_day") == 1, F.col(DAY))).over(running())
        return [
            last.alias("last_confirmed_lesson_date"),
            F.datediff(date, last).alias("n_days_since_last_confirmed_lesson"),
            _count0("les_new").alias("num_confirmed_lessons_during_sub"),
            F.coalesce(safe_ratio(_run_sum("les_rating_sum"), _run_sum("les_rows")), F.lit(0.0)).alias(
                "avg_lesson_rating"
            ),
        ]
    if group == "messages":
        return [_count0("msg_student").alias("student_messages_sent"), _count0("msg_tutor").alias("tutor_messages_sent")]
    if group == "search":
        return [_count0("src_views").alias("num_search_page_views"), _count0("src_impressions").alias("num_impressions")]
    if group == "status":
        return [
            F.bool_and("sta_all").over(same_day()).alias("subscription_active_day"),
            churn_from_active(F.bool_or("sta_label_day").over(whole())).alias("churn_day_33"),
        ]
    if group == "payment":
        pay = F.max("pay_first").over(whole())
        return [pay["hours"].alias("hours"), pay["subject"].alias("subject"), pay["gmv_proceeds_usd"].alias("gmv_proceeds_usd")]
    raise ValueError(f"unknown feature group {group!r}")


def accumulate(
    spine: DataFrame,
    facts: Iterable[DataFrame],
    groups: Sequence[str] = ALL_GROUPS,
    key_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Spine rows with the running features of ``groups``.

    ``facts`` are in-window fact frames keyed by (student_id, day); columns a
    frame lacks are null. Output: ``key_columns`` (default: all spine columns)
    then the feature columns of ``groups`` in training-table order.
    """
    keys = list(key_columns or SPINE_COLUMNS)
    rows = spine.select(*keys, F.col("first_sub_payment_date").alias("_fs"), F.col("date_dt").alias(DAY), F.lit(True).alias("_spine"))
    stacked = rows
    for f in facts:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    exprs: list[Column] = []
    for g in ALL_GROUPS:
        if g in groups:
            exprs.extend(_group_exprs(g))
    out = stacked.select(*keys, "_spine", *exprs).where(F.col("_spine"))
    return out.drop("_spine")
