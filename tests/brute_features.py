"""The training table by plain loops over lists of rows (tests only)."""

from __future__ import annotations

import datetime as dt

from attrition.config import CONFIRMED_LESSON_STATUSES, ChurnConfig


def low(values):
    """Sort key of a tuple with nulls first, as structs compare."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in values)


def ratio(values, over=None):
    kept = [v for v in values if v is not None]
    n = len(kept) if over is None else over
    return sum(kept) / n if n else None


def total(values):
    kept = [v for v in values if v is not None]
    return sum(kept) if kept else None


def training_table(t: dict[str, list[tuple]], cfg: ChurnConfig, today: dt.date | None = None) -> list[tuple]:
    """Rows in the order of TRAINING_COLUMNS; ``t`` maps source names to rows in schema order."""
    today = today or dt.date.today()
    start = dt.date.fromisoformat(cfg.calendar_start)
    calendar = {d for (d,) in t["dim_date"] if start <= d < today}
    label = dt.timedelta(days=cfg.label_day)
    active: dict = {}
    for user, tutoring, day, first, on in t["subscription_logs"]:
        if on and first is not None and day is not None and day <= first.date() + label and tutoring is not None:
            active.setdefault(user, {}).setdefault(day, set()).add(tutoring)
    cohort = {u for u, days in active.items() if all(len(s) == 1 for s in days.values())}
    spine: dict = {}
    for sid, fp, fs, country, focus, region, margin, lang, staff in t["dim_student"]:
        if fp is None or fs is None or staff is not False or sid not in cohort:
            continue
        row = (fp.date(), fs.date(), country, focus, region, margin, lang)
        for d in calendar:
            if max(row[0], row[1]) <= d <= row[1] + label:
                old = spine.get((sid, d))
                if old is None or low(row) < low(old):
                    spine[sid, d] = row
    out = []
    for (sid, d), (fp, fs, country, focus, region, margin, lang) in spine.items():
        inside = lambda ts: ts is not None and fs <= ts.date() <= d  # noqa: E731, B023
        ses = [r for r in t["sessions"] if r[0] == sid and inside(r[1])]
        app = [r for r in ses if r[4] is not None]
        web = [r for r in ses if r[4] is None]
        les = [r for r in t["lessons"] if r[1] == sid and r[3] in CONFIRMED_LESSON_STATUSES and inside(r[2])]
        last_lesson = max((r[2].date() for r in les), default=None)
        last_session = max((r[1].date() for r in ses), default=None)
        said = [(a, thread) for thread in t["message_threads"] if thread[1] == sid for i, a, ts in t["messages"] if i == thread[0] and a is not None and inside(ts)]
        pay = min(((h, s, g) for u, n, m, h, s, g in t["payments"] if u == sid and n == 1 and m == 1), key=low, default=(None, None, None))
        seen = [r[2] for r in t["events"] if r[0] == sid and inside(r[1])]
        status = [r[4] for r in t["subscription_logs"] if r[0] == sid and r[2] == d and r[4] is not None]
        churned = not any(r[4] for r in t["subscription_logs"] if r[0] == sid and r[2] == fs + label)
        pages, secs = (lambda rows, i: [r[i] for r in rows]), 3
        out.append(
            (
                sid, d, fp, (d - fp).days, fs, (d - fs).days, country, focus, region, margin, lang,
                all(status) if status else None, churned,
                last_lesson, (d - last_lesson).days if les else None, len({r[0] for r in les if r[0] is not None}),
                sum(r[4] or 0.0 for r in les) / len(les) if les else 0.0,
                total(pages(ses, 2)), ratio(pages(ses, 2)), len({r[1].date() for r in ses}), total(pages(ses, secs)), ratio(pages(ses, secs)),
                total(pages(app, 2)), ratio(pages(app, 2)), total(pages(app, secs)), ratio(pages(app, secs)),
                total(pages(web, 2)), ratio(pages(web, 2)), total(pages(web, secs)), ratio(pages(web, secs)),
                (d - last_session).days if ses else None,
                sum(a == thread[1] for a, thread in said), sum(a == thread[2] for a, thread in said),
                *pay, seen.count("search_completed"), seen.count("search_card_viewed"),
            )
        )
    return out
