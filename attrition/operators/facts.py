"""Per-(student, day) pre-aggregates of each activity source.

Every feature in the training table is "facts from first_sub up to this day".
The raw rows of all sources are projected to common keys, stacked, and reduced
by one aggregate to a row per (student, day) with decomposable partial results
(sums, non-null counts, flags). It combines on the map side, so a student with a
third of all rows leaves each map task as at most a few rows per day before
anything is shuffled. Running totals over these rows (``operators.accumulate``)
then give the features.

Column prefixes: ses_ sessions, les_ lessons, msg_ messages, src_ search,
sta_ subscription status, pay_ first payment.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.config import (
    CONFIRMED_LESSON_STATUSES,
    IMPRESSION_EVENT,
    LABEL_DAY,
    SEARCH_PAGE_VIEW_EVENT,
)
from attrition.functions.dates import as_date

DAY = "day"


def in_fact_range(df: DataFrame, ts_col: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Rows with ``lo <= ts < hi``; literals, so the predicate reaches the scan."""
    ts_type = df.schema[ts_col].dataType
    return df.where((F.col(ts_col) >= F.lit(lo).cast(ts_type)) & (F.col(ts_col) < F.lit(hi).cast(ts_type)))


def session_rows(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("start_ts").isNotNull()).select(
        F.col("user_id").alias("student_id"),
        as_date("start_ts").alias(DAY),
        F.lit(1).alias("ses_row"),
        F.col("app_version").isNotNull().alias("ses_app"),
        F.col("pages_viewed").alias("ses_pages"),
        F.col("duration_sec").alias("ses_dur"),
    )


def _confirmed(lessons: DataFrame) -> DataFrame:
    return lessons.where(
        F.col("lesson_status").isin(*CONFIRMED_LESSON_STATUSES) & F.col("lesson_ts").isNotNull()
    )


#: Longest label day whose earlier occurrences fit a lesson's 64-bit mask of days.
MASK_DAYS = 62


def lesson_rows(lessons: DataFrame, label_day: int = LABEL_DAY) -> DataFrame:
    """Confirmed lessons, per day, from one scan and one aggregate.

    Two kinds of rows: totals of a (student, day) - number of rows and the sum of the
    coalesced ratings (the average counts every row) - and one row for each distinct
    (student, lesson, day) with the lesson's previous day, ``les_prev``. A lesson counts
    as new on day d of a student's window iff it occurs on d and did not occur in
    [first_sub, d - 1], i.e. its previous day is before first_sub. first_sub lies in
    [d - label_day, d], so an earlier previous day (or none) is clamped to
    d - label_day - 1 without changing the outcome. Rows are then counted per
    (student, day, previous day): at most label_day + 2 rows a student-day, however
    many lessons a student has.

    The days of a lesson are bits of a mask that the aggregate ORs: constant state,
    whatever the calendar. A mask stands for one block of days and the ``label_day``
    days before it (64 bits together); a row also sets its bit in the next blocks that
    look back at it, and each block tells the previous days of its own days only.
    """
    if label_day > MASK_DAYS:
        return _lesson_totals(lessons).unionByName(_lesson_days(lessons, label_day), allowMissingColumns=True)
    own = 64 - label_day  # days of a block
    number = F.unix_date(as_date("lesson_ts"))
    each = _confirmed(lessons).select(
        "student_id", F.col("id").alias("_lesson"), number.alias("_n"), F.coalesce(F.col("rating_amount").cast("double"), F.lit(0.0)).alias("_rating")
    )
    first, last = F.floor(F.col("_n") / own), F.floor((F.col("_n") + label_day) / own)
    blocks = F.when(F.col("_lesson").isNotNull(), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    each = each.select("*", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), blocks)).alias("_block"))
    total = F.col("_block").isNull()
    bit = F.expr(f"shiftleft(1L, cast(_n - _block * {own} + {label_day} as int))")
    merged = each.groupBy("student_id", "_block", F.when(total, F.col("_n")).alias("_n"), F.when(~total, F.col("_lesson")).alias("_lesson")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_rating").alias("_rating"), F.bit_or(F.when(~total, bit)).alias("_days")
    )
    one_day = "struct(date_from_unix_date(cast(_n as int)) as {day}, cast(null as date) as les_prev, _rows as les_rows, _rating as les_rating, cast(null as bigint) as les_first)"
    # bit p is day _block * own - label_day + p; the highest bit below p is the previous day
    start = f"cast(_block * {own} - {label_day} as int)"
    mine = f"(_days & {-(1 << label_day)}L)"  # the block's own days

    def day_row(p: str) -> str:
        below = f"(_days & ~shiftleft(-1L, {p}))"
        floor = f"date_from_unix_date({start} + {p} - {label_day} - 1)"
        prev = f"greatest({floor}, if({below} = 0, null, date_from_unix_date({start} + length(bin({below})) - 1)))"
        return (
            f"struct(date_from_unix_date({start} + {p}) as {DAY}, {prev} as les_prev, cast(null as bigint) as les_rows, "
            "cast(null as double) as les_rating, 1L as les_first)"
        )

    # most lessons have one day in a block; only the others need a look at every bit
    several = f"transform(filter(sequence({label_day}, 63), p -> getbit(_days, p) = 1), p -> {day_row('p')})"
    one = f"array({day_row(f'(length(bin({mine})) - 1)')})"
    days = f"if(bit_count({mine}) = 1, {one}, if({mine} = 0, array(), {several}))"
    out = F.expr(f"inline(if(_block is null, array({one_day.format(day=DAY)}), {days}))")
    return merged.select("student_id", out)


def _lesson_totals(lessons: DataFrame) -> DataFrame:
    rating = F.coalesce(F.col("rating_amount").cast("double"), F.lit(0.0))
    return _confirmed(lessons).select("student_id", as_date("lesson_ts").alias(DAY), F.lit(1).cast("bigint").alias("les_rows"), rating.alias("les_rating"))


def _lesson_days(lessons: DataFrame, label_day: int) -> DataFrame:
    """Distinct (student, lesson, day) with the previous day, from sets of days: for
    label days beyond ``MASK_DAYS``."""
    ids = _confirmed(lessons).where(F.col("id").isNotNull())
    days = ids.groupBy("student_id", F.col("id").alias("_lesson")).agg(F.array_sort(F.collect_set(as_date("lesson_ts"))).alias("_days"))
    each = days.select("student_id", "_days", F.posexplode("_days").alias("_i", DAY))
    prev = F.when(F.col("_i") > 0, F.expr("_days[_i - 1]"))
    # greatest() skips nulls: a lesson without a previous day gets the floor,
    # which is before first_sub as well, so it counts as new.
    return each.select("student_id", DAY, F.greatest(prev, F.date_sub(F.col(DAY), label_day + 1)).alias("les_prev"), F.lit(1).cast("bigint").alias("les_first"))


def message_rows(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages by the student and by the tutor.

    Messages are counted per (thread, author, day) before the join to threads,
    so a busy thread reaches the join as a handful of rows.
    """
    per_author = (
        messages.where(F.col("author_id").isNotNull() & F.col("time_posted").isNotNull())
        .groupBy("thread_id", "author_id", as_date("time_posted").alias(DAY))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    t = threads.select(F.col("id").alias("thread_id"), F.col("user_id").alias("student_id"), "tutor_id")
    return per_author.join(t, "thread_id").select(
        "student_id",
        DAY,
        F.when(F.col("author_id") == F.col("student_id"), F.col("n")).alias("msg_student"),
        F.when(F.col("author_id") == F.col("tutor_id"), F.col("n")).alias("msg_tutor"),
    )


def search_rows(events: DataFrame) -> DataFrame:
    name = F.col("event_name")
    return events.where(name.isin(SEARCH_PAGE_VIEW_EVENT, IMPRESSION_EVENT) & F.col("event_ts").isNotNull()).select(
        F.col("user_id").alias("student_id"),
        as_date("event_ts").alias(DAY),
        F.when(name == SEARCH_PAGE_VIEW_EVENT, 1).alias("src_view"),
        F.when(name == IMPRESSION_EVENT, 1).alias("src_impression"),
    )


def status_rows(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("subscription_log_date").isNotNull()).select(
        F.col("user_id").alias("student_id"),
        F.col("subscription_log_date").cast("date").alias(DAY),
        F.col("subscription_active_day").alias("sta"),
    )


def _pair(prefix: str, col: Column) -> list[Column]:
    return [F.sum(col).alias(f"{prefix}_sum"), F.count(col).alias(f"{prefix}_n")]


def _aggregates(group: str) -> list[Column]:
    """Decomposable results of one source's columns per (student, day)."""
    if group == "sessions":
        app, web = (lambda c: F.when(F.col("ses_app"), F.col(c))), (lambda c: F.when(~F.col("ses_app"), F.col(c)))
        return [
            F.max("ses_row").alias("ses_day"),
            *_pair("ses_pages", F.col("ses_pages")),
            *_pair("ses_dur", F.col("ses_dur")),
            *_pair("ses_app_pages", app("ses_pages")),
            *_pair("ses_app_dur", app("ses_dur")),
            *_pair("ses_web_pages", web("ses_pages")),
            *_pair("ses_web_dur", web("ses_dur")),
        ]
    if group == "lessons":
        return [
            F.max(F.when(F.col("les_rows") > 0, F.lit(1))).alias("les_day"),
            F.sum("les_rows").alias("les_rows"),
            F.sum("les_rating").alias("les_rating_sum"),
            F.sum("les_first").alias("les_cand"),
        ]
    if group == "messages":
        return [F.sum("msg_student").alias("msg_student"), F.sum("msg_tutor").alias("msg_tutor")]
    if group == "search":
        return [F.count("src_view").alias("src_views"), F.count("src_impression").alias("src_impressions")]
    if group == "status":
        # FALSE if any row is FALSE, TRUE if all non-null rows are TRUE, null
        # without non-null rows; any: some tutoring active (decides the label).
        return [F.bool_and("sta").alias("sta_all"), F.bool_or("sta").alias("sta_any")]
    raise ValueError(f"unknown fact group {group!r}")


def daily(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All sources' stacked rows reduced once, per (student, day) and, for the
    distinct-lesson rows, the lesson's previous day."""
    keys = ["student_id", DAY] + ["les_prev"] * ("lessons" in groups)
    return rows.groupBy(*keys).agg(*[c for g in groups for c in _aggregates(g)])


def payment_per_student(payments: DataFrame) -> DataFrame:
    """The first package per student; of several, the smallest (hours, subject, gmv)."""
    first = payments.where(
        (F.col("user_subscription_package_order") == 1) & (F.col("tutoring_subscription_package_order") == 1)
    )
    pay = F.struct(
        F.col("hours").cast("double").alias("hours"),
        F.col("subject").cast("string").alias("subject"),
        F.col("gmv_proceeds_usd").cast("double").alias("gmv_proceeds_usd"),
    )
    return first.groupBy(F.col("user_id").alias("student_id")).agg(F.min(pay).alias("pay_first")).withColumn(
        DAY, F.lit(None).cast("date")
    )


def within_window(facts: DataFrame, bounds: DataFrame, label_day: int = LABEL_DAY) -> DataFrame:
    """Keep facts dated in [first_sub, first_sub + label_day] of a cohort student.

    ``bounds`` has one row per cohort student and first subscription date (ids that
    the student table repeats may have several); the join is on student_id only.
    AQE broadcasts it when its runtime size is small and otherwise shuffles it.
    Rows without a day (per-student facts) pass.
    """
    b = bounds.select("student_id", F.col("first_sub_payment_date").alias("_fs"))
    j = facts.join(b, "student_id")
    day = F.col(DAY)
    keep = day.isNull() | ((day >= F.col("_fs")) & (day <= F.date_add("_fs", label_day)))
    derived = []
    if "sta_any" in facts.columns:
        derived.append(F.when(day == F.date_add("_fs", label_day), F.col("sta_any")).alias("sta_label_day"))
    if "les_prev" in facts.columns:
        derived.append(F.when(F.col("les_prev") < F.col("_fs"), F.col("les_cand")).alias("les_new"))
    return j.where(keep).select(*[c for c in facts.columns], "_fs", *derived)
