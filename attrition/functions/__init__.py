"""Column expressions shared by the operators (all built-in Spark functions)."""

from attrition.functions.dates import add_days, as_date, day_diff
from attrition.functions.labels import churn_from_active, threshold_flag
from attrition.functions.ratios import safe_ratio, zero_if_undefined

__all__ = [
    "add_days",
    "as_date",
    "day_diff",
    "churn_from_active",
    "threshold_flag",
    "safe_ratio",
    "zero_if_undefined",
]
