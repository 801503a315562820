"""Sources -> training table (the data-preparation job, C1-C9)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import TRAINING_COLUMNS, ChurnConfig
from attrition.operators import accumulate as acc
from attrition.operators import facts
from attrition.operators.prefilter import Members, keep_members, members
from attrition.operators.spine import eligible_students, single_sub_cohort, spine_from_students
from attrition.session import ensure_checkpoint_dir
from attrition.sources.bundle import ChurnSources


@dataclass
class CohortFrames:
    spine: DataFrame  # one row per (student, day) of the cohort
    bounds: DataFrame  # one row per cohort student and first_sub_payment_date
    lo: dt.date  # first day that a counted fact can have
    hi: dt.date  # day after the last one
    n_students: int

    @cached_property
    def members(self) -> Members | None:
        """The filter that keeps facts of cohort students."""
        return members(self.bounds, "student_id", self.n_students)

    def threads(self, message_threads: DataFrame) -> tuple[DataFrame, Members | None]:
        """The cohort's message threads, and the filter that keeps their messages
        (sized for a few threads a student)."""
        mine = keep_members(self.members, message_threads, "user_id")
        return mine, members(mine, "id", 4 * self.n_students) if self.members else None


def cohort_frames(src: ChurnSources, cfg: ChurnConfig = ChurnConfig()) -> CohortFrames:
    """Cohort students (one row each), their spine and window bounds.

    The cohort feeds the spine, the fact window bound, the membership filter and the
    date range of the fact scans. It is one row per cohort student and is checkpointed once to the
    shared checkpoint folder: computed once, lineage cut, its real size known to
    AQE for the join strategy, and the range of its first subscriptions known as
    literals, which the fact scans push down.
    """
    cohort = single_sub_cohort(eligible_students(src.dim_student), src.subscription_logs, cfg.label_day)
    ensure_checkpoint_dir(cohort.sparkSession)
    cohort = cohort.checkpoint(eager=True)
    spine = spine_from_students(cohort, src.dim_date, cfg.calendar_start, cfg.as_of, cfg.label_day)
    first = F.col("first_sub_payment_date")
    lo, hi, n = cohort.agg(F.min(first), F.date_add(F.max(first), cfg.label_day + 1), F.count(F.lit(1))).first()
    never = dt.date(1970, 1, 1)  # an empty cohort needs no facts
    # one shuffle by student serves the distinct dates and the join with the facts
    starts = cohort.groupBy("student_id").agg(F.collect_set(first).alias("_starts"))
    bounds = starts.select("student_id", F.explode("_starts").alias("first_sub_payment_date"))
    return CohortFrames(spine=spine, bounds=bounds, lo=lo or never, hi=hi or never, n_students=n)


def dated_rows(src: ChurnSources, groups: Sequence[str], frames: CohortFrames | None, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    """The rows of the dated sources of ``groups``, stacked: those inside the cohort's
    range of dates and of students that pass the cohort's membership filter (without
    ``frames``: all)."""
    look_back = dt.timedelta(days=cfg.label_day + 1)  # a lesson's earlier days decide whether it is new

    def mine(df: DataFrame, key: str, ts: str, back: dt.timedelta = dt.timedelta(0)) -> DataFrame:
        if frames is None:
            return df
        return keep_members(frames.members, facts.in_fact_range(df, ts, frames.lo - back, frames.hi), key)

    rows: list[DataFrame] = []
    if "sessions" in groups:
        rows.append(facts.session_rows(mine(src.sessions, "user_id", "start_ts")))
    if "lessons" in groups:
        rows.append(facts.lesson_rows(mine(src.lessons, "student_id", "lesson_ts", look_back), cfg.label_day))
    if "messages" in groups:
        threads, messages = src.message_threads, src.messages
        if frames is not None:
            threads, of_threads = frames.threads(threads)
            messages = keep_members(of_threads, facts.in_fact_range(messages, "time_posted", frames.lo, frames.hi), "thread_id")
        rows.append(facts.message_rows(threads, messages))
    if "search" in groups:
        rows.append(facts.search_rows(mine(src.events, "user_id", "event_ts")))
    if "status" in groups:
        rows.append(facts.status_rows(mine(src.subscription_logs, "user_id", "subscription_log_date")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def daily_facts(src: ChurnSources, groups: Sequence[str], frames: CohortFrames, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    """Per-(student, day) reductions of the dated sources of ``groups``, before the
    window bound of each student."""
    return facts.daily(dated_rows(src, groups, frames, cfg), [g for g in groups if g != "payment"])


def feature_frame(
    src: ChurnSources,
    groups: tuple[str, ...] = acc.ALL_GROUPS,
    cfg: ChurnConfig = ChurnConfig(),
    frames: CohortFrames | None = None,
    key_columns: list[str] | None = None,
) -> DataFrame:
    """Cumulative form: spine rows with the features of ``groups``.

    The reduced rows of all sources are bounded to each student's window with a single join, so no
    join ever sees raw fact rows.
    """
    frames = frames or cohort_frames(src, cfg)
    dated = [daily_facts(src, groups, frames, cfg)] if set(groups) - {"payment"} else []
    if "payment" in groups:
        dated.append(facts.payment_per_student(src.payments))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated)
    return acc.accumulate(frames.spine, [facts.within_window(stacked, frames.bounds, cfg.label_day)], groups, key_columns)


def build_training_table(src: ChurnSources, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    """The 38-column training table, one row per (student_id, date_dt)."""
    return feature_frame(src, acc.ALL_GROUPS, cfg).select(*TRAINING_COLUMNS)


__all__ = ["CohortFrames", "cohort_frames", "dated_rows", "daily_facts", "feature_frame", "build_training_table"]
