"""Entity-day spine (C1) and the single-active-subscription cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import LABEL_DAY
from attrition.functions.dates import add_days, as_date, as_of_date


def calendar(dates: DataFrame, start: str, as_of: str | None) -> DataFrame:
    """Dates with ``start <= date_dt < as_of``, one row per date.

    Bounded by the number of days in [start, as_of): safe to broadcast.
    """
    d = F.col("date_dt").cast("date")
    return (
        dates.select(d.alias("date_dt"))
        .where((F.col("date_dt") >= F.lit(start).cast("date")) & (F.col("date_dt") < as_of_date(as_of)))
        .distinct()
    )


def eligible_students(students: DataFrame) -> DataFrame:
    """Non-staff students with a subscription, their dates and static attributes.

    One row per student and distinct attributes. Should the student table repeat
    an id, ``earlier`` holds the date pairs of the id's smaller attribute tuples,
    so that the spine can take each date from the smallest tuple that has it. The
    group-by shuffles students on student_id, which the cohort semi join and the
    per-student window then reuse.
    """
    eligible = students.where(
        F.col("first_subscription_package_ts").isNotNull()
        & F.col("first_payment_ts").isNotNull()
        & (F.col("is_staff") == F.lit(False))
    )
    attrs = F.struct(
        as_date("first_payment_ts").alias("first_payment_date"),
        as_date("first_subscription_package_ts").alias("first_sub_payment_date"),
        F.col("country_code"),
        F.col("focus_countries"),
        F.col("region"),
        F.col("projected_gross_margin_360d"),
        F.col("language_version"),
    )
    per_student = eligible.groupBy(F.col("id").alias("student_id")).agg(F.array_sort(F.collect_set(attrs)).alias("_all"))
    each = per_student.select("student_id", "_all", F.posexplode("_all").alias("_i", "_a"))
    dates = lambda a: F.struct(a["first_payment_date"].alias("p"), a["first_sub_payment_date"].alias("s"))
    return each.select("student_id", "_a.*", F.transform(F.expr("slice(_all, 1, _i)"), dates).alias("earlier"))


def spine_from_students(
    students: DataFrame,
    dates: DataFrame,
    start: str,
    as_of: str | None,
    label_day: int = LABEL_DAY,
) -> DataFrame:
    """One row per (student, date) with ``max(first_payment, first_sub) <= date
    <= first_sub + label_day`` and the date in the calendar.

    The reference crosses every date with every student and filters; here each
    student generates only its own (at most label_day + 1) dates, and a
    broadcast semi join keeps those present in the calendar.
    """
    lo = F.greatest("first_payment_date", "first_sub_payment_date", F.lit(start).cast("date"))
    hi = F.least(add_days("first_sub_payment_date", label_day), F.date_sub(as_of_date(as_of), 1))
    spanned = students.where(lo <= hi).withColumn("date_dt", F.explode(F.sequence(lo, hi)))
    day = F.col("date_dt")
    spanned = spanned.where(~F.exists("earlier", lambda e: (e["p"] <= day) & (e["s"] <= day) & (day <= F.date_add(e["s"], label_day))))
    in_calendar = spanned.join(F.broadcast(calendar(dates, start, as_of)), "date_dt", "left_semi")
    return in_calendar.select(
        "student_id",
        "date_dt",
        "first_payment_date",
        F.datediff("date_dt", "first_payment_date").alias("student_age"),
        "first_sub_payment_date",
        F.datediff("date_dt", "first_sub_payment_date").alias("days_since_first_sub_payment"),
        "country_code",
        "focus_countries",
        "region",
        "projected_gross_margin_360d",
        "language_version",
    )


def build_spine(
    students: DataFrame,
    dates: DataFrame,
    start: str,
    as_of: str | None = None,
    label_day: int = LABEL_DAY,
) -> DataFrame:
    """The student x day spine before the cohort filter."""
    return spine_from_students(eligible_students(students), dates, start, as_of, label_day)


def single_sub_users(logs: DataFrame, label_day: int = LABEL_DAY) -> DataFrame:
    """Users whose busiest active day within label_day of their first
    subscription event has exactly one distinct tutoring (A5, A13).

    max over days of COUNT(DISTINCT tutoring_id) = 1 holds exactly when no day
    has two different tutorings (min < max) and some day has one (min not null).
    min/max aggregate partially on the map side, so a user with a huge log is
    reduced before the shuffle; COUNT(DISTINCT) would expand every row first.
    """
    active = logs.where(
        (F.col("subscription_active_day") == F.lit(True))
        & (F.col("subscription_log_date") <= add_days("first_subscription_event_ts", label_day))
    )
    per_day = active.groupBy("user_id", "subscription_log_date").agg(
        F.min("tutoring_id").alias("lo"), F.max("tutoring_id").alias("hi")
    )
    per_user = per_day.groupBy("user_id").agg(
        F.max(F.when(F.col("lo") < F.col("hi"), F.lit(1))).alias("multi"),
        F.count("lo").alias("days_with_one"),
    )
    return per_user.where(F.col("multi").isNull() & (F.col("days_with_one") > 0)).select("user_id")


def single_sub_cohort(spine_or_students: DataFrame, logs: DataFrame, label_day: int = LABEL_DAY) -> DataFrame:
    """Keep rows of students in the single-subscription cohort (J2 as a semi join)."""
    users = single_sub_users(logs, label_day).withColumnRenamed("user_id", "_cohort_user")
    return spine_or_students.join(
        users, spine_or_students["student_id"] == users["_cohort_user"], "left_semi"
    )
