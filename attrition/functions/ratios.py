"""Division that never raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def zero_if_undefined(num: str | Column, den: str | Column) -> Column:
    """num / den, 0.0 when den is 0 (the metric convention for empty classes)."""
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))
