"""Fixed scoring rules: prediction frames that SQL can reproduce exactly.

The evaluation operators take any prediction frame. To check them against an
independent SQL engine, these rules score test rows with small integer
formulas (clamped to 0..100, divided by 100), so both engines produce the
same doubles bit for bit. They stand in for fitted models only in checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.config import HORIZON_COL, LABEL

# Integer weights of the two scoring rules (shared with the SQL twin).
RULES: dict[str, dict[str, int]] = {
    "score_recency": {
        "_bias": 30,
        "days_since_last_session": 3,
        "n_days_since_last_confirmed_lesson": 2,
        "num_confirmed_lessons_during_sub": -4,
    },
    "score_engagement": {
        "_bias": 70,
        "days_with_session": -2,
        "student_messages_sent": -3,
        "num_search_page_views": -1,
        "days_since_first_sub_payment": 1,
    },
}


def rule_score(weights: dict[str, int]) -> Column:
    s: Column = F.lit(float(weights["_bias"]))
    for col, w in weights.items():
        if col != "_bias":
            s = s + F.lit(w) * F.col(col).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)) / F.lit(100.0)


def rule_predictions(rows: DataFrame, rules: dict[str, dict[str, int]] = RULES) -> DataFrame:
    """(horizon, model, student_id, label, prediction, p_churn) for each rule."""
    frames = [
        rows.select(
            F.col(HORIZON_COL).alias("horizon"),
            F.lit(name).alias("model"),
            "student_id",
            F.col(LABEL).alias("label"),
            rule_score(w).alias("p_churn"),
        ).withColumn("prediction", F.col("p_churn") >= F.lit(0.5))
        for name, w in rules.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("horizon", "model", "student_id", "label", "prediction", "p_churn")
