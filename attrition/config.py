"""Parameters of the churn workload and the fixed column lists of its tables."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that define the workload (must stay as they are for equal results).
LABEL_DAY = 33
CALENDAR_START = "2023-01-01"
HORIZONS = (7, 14, 21)
CONFIRMED_LESSON_STATUSES = ("COMPLETED", "AUTOCOMPLETED")
SEARCH_PAGE_VIEW_EVENT = "search_completed"
IMPRESSION_EVENT = "search_card_viewed"
THRESHOLDS = (0.9, 0.85, 0.8, 0.75, 0.7, 0.6)
SPLIT_SEED = 123
TEST_PERCENT = 33
LOGREG_MAX_ITER = {7: 1000, 14: 1000, 21: 2000}
GBT_TREES = 100
GBT_STEP = 1.0
GBT_DEPTH = 3
TREE_MAX_DEPTH = 30  # Spark's limit; the reference grows trees without a limit
CATEGORICAL_FILL = "empty"

LABEL = "churn_day_33"
HORIZON_COL = "days_since_first_sub_payment"

# The 38 training-table columns, in output order.
SPINE_COLUMNS = [
    "student_id",
    "date_dt",
    "first_payment_date",
    "student_age",
    "first_sub_payment_date",
    "days_since_first_sub_payment",
    "country_code",
    "focus_countries",
    "region",
    "projected_gross_margin_360d",
    "language_version",
]
STATUS_COLUMNS = ["subscription_active_day", LABEL]
LESSON_COLUMNS = [
    "last_confirmed_lesson_date",
    "n_days_since_last_confirmed_lesson",
    "num_confirmed_lessons_during_sub",
    "avg_lesson_rating",
]
SESSION_COLUMNS = [
    "sum_pages_viewed_all",
    "avg_pages_viewed_all",
    "days_with_session",
    "sum_session_duration_all",
    "avg_session_duration_all",
    "sum_page_viewed_app",
    "avg_page_viewed_app",
    "sum_session_duration_app",
    "avg_session_duration_app",
    "sum_page_viewed_non_app",
    "avg_page_viewed_non_app",
    "sum_session_duration_non_app",
    "avg_session_duration_non_app",
    "days_since_last_session",
]
MESSAGE_COLUMNS = ["student_messages_sent", "tutor_messages_sent"]
PAYMENT_COLUMNS = ["hours", "subject", "gmv_proceeds_usd"]
SEARCH_COLUMNS = ["num_search_page_views", "num_impressions"]
TRAINING_COLUMNS = (
    SPINE_COLUMNS
    + STATUS_COLUMNS
    + LESSON_COLUMNS
    + SESSION_COLUMNS
    + MESSAGE_COLUMNS
    + PAYMENT_COLUMNS
    + SEARCH_COLUMNS
)

# Model matrix: the 30 model columns in the reference's order, then the label.
MODEL_COLUMNS = [
    "student_age",
    "days_since_first_sub_payment",
    "n_days_since_last_confirmed_lesson",
    "num_confirmed_lessons_during_sub",
    "hours",
    "subject",
    "gmv_proceeds_usd",
    "avg_lesson_rating",
    "sum_pages_viewed_all",
    "avg_pages_viewed_all",
    "days_with_session",
    "sum_session_duration_all",
    "avg_session_duration_all",
    "sum_page_viewed_app",
    "avg_page_viewed_app",
    "sum_session_duration_app",
    "avg_session_duration_app",
    "sum_page_viewed_non_app",
    "avg_page_viewed_non_app",
    "sum_session_duration_non_app",
    "avg_session_duration_non_app",
    "days_since_last_session",
    "student_messages_sent",
    "tutor_messages_sent",
    "country_code",
    "focus_countries",
    "region",
    "language_version",
    "num_search_page_views",
    "num_impressions",
]
CATEGORICAL_FEATURES = ["subject", "country_code", "focus_countries", "region", "language_version"]
# Passed through to the models unfilled and uncast, as in the reference.
PASSTHROUGH_FEATURES = ["days_since_first_sub_payment"]
NUMERIC_FEATURES = [c for c in MODEL_COLUMNS if c not in CATEGORICAL_FEATURES + PASSTHROUGH_FEATURES]


@dataclass(frozen=True)
class ChurnConfig:
    """Run parameters. ``as_of`` None means the session's current date."""

    label_day: int = LABEL_DAY
    calendar_start: str = CALENDAR_START
    as_of: str | None = None
    horizons: tuple[int, ...] = HORIZONS
    split_seed: int = SPLIT_SEED
    test_percent: int = TEST_PERCENT
    thresholds: tuple[float, ...] = THRESHOLDS
    # Trees bin continuous features; more bins bring the split points closer to the
    # exhaustive search of a single-machine tree.
    max_bins: int = 256
    # Iterative learners run one job an iteration (a tree level for trees), so the
    # encoded rows of a fit are gathered into partitions of about this many bytes.
    fit_partition_bytes: int = 64 << 20
    # Logistic regression stops when the objective's relative change falls below this.
    logreg_tol: float = 1e-10
