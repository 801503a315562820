from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attrition.session import build_session  # noqa: E402
from attrition.sources.bundle import ChurnSources  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app="attrition-tests")
    yield s
    s.stop()


SCHEMAS = {
    "dim_date": "date_dt date",
    "dim_student": (
        "id bigint, first_payment_ts timestamp_ntz, first_subscription_package_ts timestamp_ntz, "
        "country_code string, focus_countries string, region string, projected_gross_margin_360d double, "
        "language_version string, is_staff boolean"
    ),
    "subscription_logs": (
        "user_id bigint, tutoring_id bigint, subscription_log_date date, "
        "first_subscription_event_ts timestamp_ntz, subscription_active_day boolean"
    ),
    "sessions": "user_id bigint, start_ts timestamp_ntz, pages_viewed bigint, duration_sec bigint, app_version string",
    "message_threads": "id bigint, user_id bigint, tutor_id bigint",
    "messages": "thread_id bigint, author_id bigint, time_posted timestamp_ntz",
    "lessons": "id bigint, student_id bigint, lesson_ts timestamp_ntz, lesson_status string, rating_amount double",
    "payments": (
        "user_id bigint, user_subscription_package_order int, tutoring_subscription_package_order int, "
        "hours double, subject string, gmv_proceeds_usd double"
    ),
    "events": "user_id bigint, event_ts timestamp_ntz, event_name string",
}


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def calendar(start: str = "2024-01-01", days: int = 60) -> list[tuple]:
    d0 = D(start)
    return [(d0 + dt.timedelta(days=i),) for i in range(days)]


@pytest.fixture
def make_sources(spark):
    def build(**tables) -> ChurnSources:
        tables.setdefault("dim_date", calendar())
        frames = {name: spark.createDataFrame(tables.get(name, []), SCHEMAS[name]) for name in SCHEMAS}
        return ChurnSources(**frames)

    return build


def student(sid, first_pay="2024-01-01 10:00:00", first_sub="2024-01-01 10:00:00", staff=False, **attrs):
    return (
        sid,
        T(first_pay) if first_pay else None,
        T(first_sub) if first_sub else None,
        attrs.get("country_code", "DE"),
        attrs.get("focus_countries", "X"),
        attrs.get("region", "EU"),
        attrs.get("margin", 1.0),
        attrs.get("language_version", "lv1"),
        staff,
    )


def log(uid, tutoring, day, first_sub="2024-01-01 10:00:00", active=True):
    return (uid, tutoring, D(day), T(first_sub), active)
