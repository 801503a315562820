"""Date arithmetic with warehouse semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(col: str | Column) -> Column:
    """``ts::date`` (F1)."""
    return F.to_date(col)


def day_diff(start: str | Column, end: str | Column) -> Column:
    """Day boundaries crossed from ``start`` to ``end`` (F2).

    Both sides are reduced to dates first, so 23:00 -> 01:00 the next day is 1.
    Spark's 3-argument DATEDIFF(DAY, ..) counts whole 24 h spans instead.
    """
    return F.datediff(F.to_date(end), F.to_date(start))


def add_days(col: str | Column, days: int) -> Column:
    """``DATEADD('DAYS', n, d)`` returning a date."""
    return F.date_add(F.to_date(col), days)


def as_of_date(as_of: str | None) -> Column:
    """``CURRENT_DATE`` or a fixed run date."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")
