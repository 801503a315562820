"""Property: the training table equals plain loops over random sources.

Random bundles include calendar gaps, first payments after the first
subscription, repeated lesson ids, null ratings/authors/statuses, several
tutorings a day, facts before first_sub and after the label day.
"""

from __future__ import annotations

import datetime as dt
import random

import pytest

from attrition.config import ChurnConfig
from attrition.plans import training_table as tt
from attrition.sources.bundle import ChurnSources
from tests.brute_features import training_table
from tests.conftest import SCHEMAS

CFG = ChurnConfig(label_day=6)
DAY0 = dt.date(2024, 3, 1)


def _ts(rnd: random.Random, lo: int, hi: int) -> dt.datetime:
    d = DAY0 + dt.timedelta(days=rnd.randint(lo, hi))
    return dt.datetime(d.year, d.month, d.day, rnd.randint(0, 23), rnd.randint(0, 59))


def _tables(seed: int) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    dates = [(DAY0 + dt.timedelta(days=i),) for i in range(-5, 40) if rnd.random() > 0.1]  # gaps
    students, logs, sessions, threads, messages, lessons, payments, events = ([] for _ in range(8))
    for sid in range(1, 13):
        fs = _ts(rnd, 0, 10)
        fp = fs + dt.timedelta(days=rnd.choice([0, 0, 1, 3]))  # sometimes later than first_sub
        students.append((sid, fp, fs, rnd.choice(["DE", "FR", None]), "X", "EU", 1.0, "lv1", rnd.random() < 0.1))
        for k in range(CFG.label_day + 3):
            day = fs.date() + dt.timedelta(days=k - 1)
            if rnd.random() < 0.8:
                logs.append((sid, sid * 10, day, fs, rnd.choice([True, True, True, False, None])))
            if rnd.random() < 0.08:
                logs.append((sid, sid * 10 + 1, day, fs, True))  # second tutoring that day
        for _ in range(rnd.randint(0, 12)):
            sessions.append((sid, _ts(rnd, -3, 25), rnd.choice([None, 1, 2, 5]), rnd.randint(1, 500),
                             rnd.choice([None, "v1"])))
        threads.append((sid * 7, sid, 1000 + sid))
        for _ in range(rnd.randint(0, 8)):
            messages.append((sid * 7, rnd.choice([sid, 1000 + sid, None]), _ts(rnd, -3, 25)))
        for _ in range(rnd.randint(0, 8)):
            lid = sid * 100 + rnd.randint(0, 4)  # repeats
            lessons.append((lid, sid, _ts(rnd, -3, 25), rnd.choice(["COMPLETED", "AUTOCOMPLETED", "CANCELLED"]),
                            rnd.choice([None, 1.0, 3.0, 5.0])))
        for o in range(rnd.randint(0, 2)):
            payments.append((sid, 1, 1, float(rnd.randint(1, 9)), rnd.choice(["a", "b"]), float(rnd.randint(1, 99))))
        for _ in range(rnd.randint(0, 6)):
            events.append((sid, _ts(rnd, -3, 25), rnd.choice(["search_completed", "search_card_viewed", "x"])))
    tables = {
        "dim_date": dates, "dim_student": students, "subscription_logs": logs, "sessions": sessions,
        "message_threads": threads, "messages": messages, "lessons": lessons, "payments": payments, "events": events,
    }
    return tables


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_training_table_equals_plain_loops(spark, seed):
    tables = _tables(seed)
    if seed == 3:  # an id that the student table repeats, with other dates
        sid, fp, fs, *rest = tables["dim_student"][0]
        tables["dim_student"] += [(sid, fp, fs + dt.timedelta(days=5), *rest), (sid, fp - dt.timedelta(days=2), fs + dt.timedelta(days=1), *rest)]
    src = ChurnSources(**{n: spark.createDataFrame(tables[n], SCHEMAS[n]) for n in SCHEMAS})
    got = sorted(map(tuple, tt.build_training_table(src, CFG).collect()), key=repr)
    want = sorted(training_table(tables, CFG), key=repr)
    assert got and got == want


def test_hot_student_is_bounded_before_the_window(spark):
    """One student holds about half of all facts: the table equals plain loops, and the rows it
    brings to the per-student window are bounded by days, not by its facts."""
    from attrition.operators import facts

    rnd = random.Random(11)
    fs = dt.datetime(2024, 3, 2, 9, 0)
    students = [(sid, fs, fs, "DE", "X", "EU", 1.0, "lv1", False) for sid in range(1, 31)]
    logs = [(sid, sid * 10, fs.date() + dt.timedelta(days=k), fs, True) for sid in range(1, 31) for k in range(8)]
    sessions, lessons = [], []
    for sid in range(1, 31):
        n = 3000 if sid == 1 else 100  # student 1: about half of all sessions and lessons
        for _ in range(n):
            sessions.append((sid, _ts(rnd, 0, 9), rnd.randint(0, 9), rnd.randint(1, 99), rnd.choice([None, "v1"])))
        for _ in range(n // 2):
            lessons.append((sid * 1000 + rnd.randint(0, 400), sid, _ts(rnd, 0, 9), "COMPLETED", rnd.choice([None, 4.0])))
    tables = {
        "dim_date": [(DAY0 + dt.timedelta(days=i),) for i in range(0, 30)],
        "dim_student": students, "subscription_logs": logs, "sessions": sessions,
        "message_threads": [], "messages": [], "lessons": lessons, "payments": [], "events": [],
    }
    src = ChurnSources(**{n: spark.createDataFrame(tables[n], SCHEMAS[n]) for n in SCHEMAS})
    got = sorted(map(tuple, tt.build_training_table(src, CFG).collect()), key=repr)
    want = sorted(training_table(tables, CFG), key=repr)
    assert got and got == want

    frames = tt.cohort_frames(src, CFG)
    daily = tt.daily_facts(src, ("sessions", "lessons"), frames, CFG)
    hot_rows = facts.within_window(daily, frames.bounds, CFG.label_day).where("student_id = 1").count()
    days = CFG.label_day + 1
    assert hot_rows <= days * 2 + days * (CFG.label_day + 2)  # session + lesson days, lesson candidates
    assert hot_rows < 3000 // 10
