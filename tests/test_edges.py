"""Hand-made edge cases on a tiny source bundle.

Each student exercises one rule; the cumulative plan and plain
must agree on every row, and key values are checked by hand.
"""

from __future__ import annotations

import pytest

from attrition.config import ChurnConfig
from attrition.plans import training_table as tt
from tests.brute_features import training_table
from tests.conftest import D, T, log, student

CFG = ChurnConfig(label_day=5)


def _logs():
    rows = []
    # 1: one tutoring active every day through the label day (01-06).
    rows += [log(1, 10, f"2024-01-0{d}") for d in range(1, 7)]
    # 2: active but no row on the label day -> churned.
    rows += [log(2, 20, f"2024-01-0{d}") for d in range(1, 5)]
    # 3: two tutorings active on one day -> not in the cohort.
    rows += [log(3, 30, "2024-01-02"), log(3, 31, "2024-01-02")]
    # 4: two tutorings on different days -> kept (E7); FALSE+TRUE -> FALSE (E8);
    #    TRUE+NULL -> TRUE.
    rows += [log(4, 40, "2024-01-01"), log(4, 41, "2024-01-03")]
    rows += [log(4, 40, "2024-01-02", active=False), log(4, 41, "2024-01-02", active=True)]
    rows += [log(4, 40, "2024-01-04", active=True), log(4, 41, "2024-01-04", active=None)]
    # 7: active through the label day.
    rows += [log(7, 70, f"2024-01-0{d}") for d in range(1, 7)]
    return rows


@pytest.fixture(scope="module")
def scenario(spark):
    from tests.conftest import SCHEMAS, calendar
    from attrition.sources.bundle import ChurnSources

    tables = {
        "dim_date": calendar(),
        "dim_student": [
            student(1),
            student(2, first_pay="2024-01-03 09:00:00", first_sub="2024-01-01 08:00:00"),
            student(3),
            student(4),
            student(5, staff=None),
            student(6, first_sub=None),
            student(7, language_version=None),
        ],
        "subscription_logs": _logs(),
        "sessions": [
            (2, T("2023-12-31 12:00:00"), 9, 900, None),  # before first_sub: ignored
            (2, T("2024-01-01 12:00:00"), 3, 300, None),  # before the spine starts: counted
            (2, T("2024-01-04 12:00:00"), None, 100, None),
            (7, T("2024-01-01 23:00:00"), 4, 40, "v1"),  # E12
            (7, T("2024-01-02 01:00:00"), 2, 20, None),
        ],
        "message_threads": [(71, 7, 1000)],
        "messages": [
            (71, 7, T("2024-01-02 10:00:00")),
            (71, 1000, T("2024-01-02 11:00:00")),
            (71, None, T("2024-01-02 12:00:00")),  # E14
            (71, 7, T("2024-01-09 10:00:00")),  # after the window
        ],
        "lessons": [
            (700, 7, T("2024-01-02 10:00:00"), "COMPLETED", None),  # E13
            (701, 7, T("2024-01-02 11:00:00"), "AUTOCOMPLETED", 4.0),
            (702, 7, T("2024-01-03 11:00:00"), "CANCELLED", 5.0),
            (701, 7, T("2024-01-04 11:00:00"), "COMPLETED", 1.0),  # same id again
        ],
        "payments": [
            (7, 1, 1, 5.0, "math", 50.0),
            (7, 1, 1, 3.0, "art", 30.0),  # E11: two first packages
            (7, 2, 1, 1.0, "x", 1.0),
        ],
        "events": [
            (7, T("2024-01-02 10:00:00"), "search_completed"),
            (7, T("2024-01-03 10:00:00"), "search_card_viewed"),
            (7, T("2024-01-03 11:00:00"), "other"),
        ],
    }
    frames = {name: spark.createDataFrame(tables.get(name, []), SCHEMAS[name]) for name in SCHEMAS}
    src = ChurnSources(**frames)
    cum = tt.build_training_table(src, CFG)
    rows = {(r.student_id, r.date_dt): r for r in cum.collect()}
    return cum, training_table({n: tables.get(n, []) for n in SCHEMAS}, CFG), rows


def test_equals_plain_loops(scenario):
    cum, plain, _ = scenario
    assert sorted(map(tuple, cum.collect()), key=repr) == sorted(plain, key=repr)


def test_cohort_and_spine(scenario):
    _, _, rows = scenario
    students = {s for s, _ in rows}
    assert students == {1, 2, 4, 7}  # 3 (two subs a day), 5 (staff null), 6 (no sub) dropped
    days_1 = sorted(d for s, d in rows if s == 1)
    assert days_1 == [D(f"2024-01-0{d}") for d in range(1, 7)]  # label_day + 1 rows (E4)
    days_2 = sorted(d for s, d in rows if s == 2)
    assert days_2[0] == D("2024-01-03") and days_2[-1] == D("2024-01-06")  # E5


def test_no_activity_defaults(scenario):
    r = scenario[2][(1, D("2024-01-03"))]  # E1
    assert r.sum_pages_viewed_all is None and r.avg_pages_viewed_all is None
    assert r.days_with_session == 0 and r.num_confirmed_lessons_during_sub == 0
    assert r.avg_lesson_rating == 0.0 and r.student_messages_sent == 0 and r.num_impressions == 0
    assert r.days_since_last_session is None and r.hours is None
    assert r.churn_day_33 is False and r.subscription_active_day is True


def test_sessions_before_spine_and_non_app(scenario):
    r = scenario[2][(2, D("2024-01-03"))]
    assert r.sum_pages_viewed_all == 3 and r.days_with_session == 1  # 01-01 counted, 12-31 not
    assert r.sum_page_viewed_app is None and r.sum_page_viewed_non_app == 3  # E2
    assert r.days_since_last_session == 2
    r4 = scenario[2][(2, D("2024-01-04"))]
    assert r4.sum_pages_viewed_all == 3 and r4.avg_pages_viewed_all == 3.0  # null pages skipped
    assert r4.sum_session_duration_all == 400 and r4.days_with_session == 2
    assert r4.churn_day_33 is True  # E10


def test_status_fan_out(scenario):
    rows = scenario[2]
    assert rows[(4, D("2024-01-02"))].subscription_active_day is False  # E8
    assert rows[(4, D("2024-01-04"))].subscription_active_day is True  # E9
    assert rows[(4, D("2024-01-05"))].subscription_active_day is None


def test_day_boundaries_lessons_messages_payment(scenario):
    rows = scenario[2]
    r2 = rows[(7, D("2024-01-02"))]
    assert r2.days_since_last_session == 0 and r2.days_with_session == 2
    r3 = rows[(7, D("2024-01-03"))]
    assert r3.days_since_last_session == 1  # 01:00 on 01-02 (E12)
    assert r2.num_confirmed_lessons_during_sub == 2 and r2.avg_lesson_rating == 2.0  # E13
    r5 = rows[(7, D("2024-01-05"))]
    assert r5.num_confirmed_lessons_during_sub == 2  # id 701 again: counted once
    assert r5.avg_lesson_rating == pytest.approx(5.0 / 3)
    assert r5.last_confirmed_lesson_date == D("2024-01-04") and r5.n_days_since_last_confirmed_lesson == 1
    assert (r2.student_messages_sent, r2.tutor_messages_sent) == (1, 1)  # null author ignored (E14)
    assert (r2.hours, r2.subject, r2.gmv_proceeds_usd) == (3.0, "art", 30.0)  # E11
    assert (r3.num_search_page_views, r3.num_impressions) == (1, 1)
    assert r2.language_version is None
