"""The nine churn sources, derived from the driver's test tables.

The test data has no churn tables, so each source is a role played by
``events``, ``customer``, ``nation``, ``region`` and ``orders``. The same
derivations are written in DuckDB SQL for the oracle (``checks/duckdb_oracle``).
``k`` is the integer in ``events.props`` (``{"k": 69}``, 0-99).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.operators.ranking import exact_row_number
from attrition.sources.bundle import ChurnSources

# Fixed values of the role mapping (shared with the DuckDB text).
STAFF_MODULUS = 37
NO_LANGUAGE_MODULUS = 11
NO_THREAD_MODULUS = 5
NO_PAYMENT_MODULUS = 13
TUTOR_ID_BASE = 1000000
LESSON_STATUSES_BY_K4 = ("COMPLETED", "AUTOCOMPLETED", "CANCELLED", "REFUNDED")
EVENT_RENAMES = {"view": "search_card_viewed", "click": "search_completed"}


def _k() -> F.Column:
    return F.col("k")


def _thread_id(user: F.Column) -> F.Column:
    return user * 10 + user % 3


def _tutor_id(user: F.Column) -> F.Column:
    return F.lit(TUTOR_ID_BASE) + user % 7


def role_sources(spark: SparkSession, sf_dir: str, rough: bool = False) -> ChurnSources:
    """The nine sources. With ``rough`` they hold what real ones do and the plain roles
    don't: days missing from the calendar, students of unknown staff flag, lesson ids
    that a student's lessons share on several days, and users with two first packages."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Seven roles come from events; each scans only its own columns and dates.
    events = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    customer = read("customer")
    nation = read("nation")
    region = read("region")
    orders = read("orders")
    user = F.col("user_id")

    day = F.to_date("ts")
    span = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    dim_date = span.select(F.explode(F.sequence("lo", "hi")).alias("date_dt"))
    if rough:
        dim_date = dim_date.where(F.dayofmonth("date_dt") % 9 != 4)

    firsts = events.groupBy("user_id").agg(
        F.min("ts").alias("first_payment_ts"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_subscription_package_ts"),
    )
    dim_student = (
        firsts.join(customer, firsts.user_id == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("user_id").alias("id"),
            "first_payment_ts",
            "first_subscription_package_ts",
            F.col("n_name").alias("country_code"),
            F.col("c_mktsegment").alias("focus_countries"),
            F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("projected_gross_margin_360d"),
            F.when(user % NO_LANGUAGE_MODULUS == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("lv"), (user % 4).cast("string")))
            .alias("language_version"),
            (F.when(user % 41 != 5, user % STAFF_MODULUS == 0) if rough else user % STAFF_MODULUS == 0).alias("is_staff"),
        )
    )

    k = _k()
    sessions = events.where(F.col("event_type").isin("view", "click")).select(
        "user_id",
        F.col("ts").alias("start_ts"),
        (k % 10).cast("bigint").alias("pages_viewed"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_sec"),
        F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("app_version"),
    )

    message_threads = (
        events.where(user % NO_THREAD_MODULUS != 0)
        .select("user_id")
        .distinct()
        .select(_thread_id(user).alias("id"), "user_id", _tutor_id(user).alias("tutor_id"))
    )
    messages = events.where(F.col("event_type").isin("click", "error")).select(
        _thread_id(user).alias("thread_id"),
        F.when(k % 3 == 0, _tutor_id(user)).when(k % 3 == 1, user).alias("author_id"),
        F.col("ts").alias("time_posted"),
    )

    status = F.element_at(F.array(*[F.lit(s) for s in LESSON_STATUSES_BY_K4]), (k % 4 + 1).cast("int"))
    lessons = events.where(F.col("event_type") == "purchase").select(
        (user * 100 + F.col("event_id") % 3 if rough else F.col("event_id")).alias("id"),
        F.col("user_id").alias("student_id"),
        F.col("ts").alias("lesson_ts"),
        status.alias("lesson_status"),
        F.when(k % 6 == 0, F.lit(None).cast("double")).otherwise((k % 6).cast("double")).alias("rating_amount"),
    )

    paying = orders.where(F.col("o_custkey") % NO_PAYMENT_MODULUS != 0)
    # Order number per customer by (date, key); the order date (in days) is a
    # monotone bucket, so a customer with many orders spans many tasks.
    numbered = exact_row_number(
        paying,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        out="_order_no",
        bucket=F.unix_date(F.to_date("o_orderdate")),
    )
    number = F.col("_order_no")
    if rough:
        number = F.when((F.col("o_custkey") % 3 == 0) & (number == 2), F.lit(1)).otherwise(number)
    payments = numbered.select(
        F.col("o_custkey").alias("user_id"),
        number.cast("int").alias("user_subscription_package_order"),
        F.lit(1).alias("tutoring_subscription_package_order"),
        (F.lit(1) + F.col("o_orderkey") % 20).cast("double").alias("hours"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_totalprice").alias("gmv_proceeds_usd"),
    )

    renamed = F.col("event_type")
    for old, new in EVENT_RENAMES.items():
        renamed = F.when(F.col("event_type") == old, F.lit(new)).otherwise(renamed)
    fact_events = events.select("user_id", F.col("ts").alias("event_ts"), renamed.alias("event_name"))

    tutoring = user * 10 + F.when(user % 4 == 0, F.col("event_id") % 2).otherwise(F.lit(0))
    logs = (
        events.where(F.col("event_type").isin("view", "signup"))
        .groupBy("user_id", tutoring.alias("tutoring_id"), day.alias("subscription_log_date"))
        .agg(F.bool_or(k % 10 != 0).alias("subscription_active_day"))
    )
    first_sub = firsts.select(
        F.col("user_id").alias("_sid"), F.col("first_subscription_package_ts").alias("first_subscription_event_ts")
    )
    subscription_logs = logs.join(first_sub, logs.user_id == first_sub._sid, "left").select(
        "user_id", "tutoring_id", "subscription_log_date", "first_subscription_event_ts", "subscription_active_day"
    )

    return ChurnSources(
        dim_date=dim_date,
        dim_student=dim_student,
        subscription_logs=subscription_logs,
        sessions=sessions,
        message_threads=message_threads,
        messages=messages,
        lessons=lessons,
        payments=payments,
        events=fact_events,
    )
