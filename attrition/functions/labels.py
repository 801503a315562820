"""Label and flag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def churn_from_active(active_on_label_day: str | Column) -> Column:
    """``CASE WHEN active = TRUE THEN FALSE ELSE TRUE END``: a missing row is churn."""
    col = F.col(active_on_label_day) if isinstance(active_on_label_day, str) else active_on_label_day
    return ~F.coalesce(col, F.lit(False))


def threshold_flag(probability: str | Column, threshold: float) -> Column:
    """``p >= t`` as a never-null boolean; false for null and for NaN (which Spark
    would order above every threshold)."""
    col = F.col(probability) if isinstance(probability, str) else probability
    return F.coalesce(~F.isnan(col) & (col >= F.lit(float(threshold))), F.lit(False))
