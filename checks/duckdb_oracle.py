"""DuckDB twins of the registered queries.

The driver pre-registers the test tables as views (events, customer, nation,
region, orders, ...). ``ROLES`` derives the nine churn sources from them with
the same rules as ``attrition.sources.roles``. The features are stated on their
own terms: a generated range of days for each student, cohort membership by the
absence of a parallel tutoring, one ledger of all dated facts with conditional
totals, and statuses as "all" and "any" over a day's rows.
"""

from __future__ import annotations

from attrition.config import (
    CATEGORICAL_FEATURES,
    LESSON_COLUMNS,
    MESSAGE_COLUMNS,
    MODEL_COLUMNS,
    NUMERIC_FEATURES,
    SEARCH_COLUMNS,
    SESSION_COLUMNS,
    THRESHOLDS,
    TRAINING_COLUMNS,
)

# Fixtures: the test data spans 30 days, so the label day is 24 (33 would
# label everyone churned); horizons stay 7, 14, 21.
FIXTURE_LABEL_DAY = 24

ROLES = """
ev AS (
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(ts AS DATE) AS d
    FROM events
),
dim_date AS (
    SELECT CAST(x AS DATE) AS date_dt
    FROM (SELECT unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS x FROM ev)
),
firsts AS (
    SELECT user_id, min(ts) AS first_payment_ts,
           min(ts) FILTER (WHERE event_type = 'purchase') AS first_subscription_package_ts
    FROM ev GROUP BY user_id
),
dim_student AS (
    SELECT f.user_id AS id, f.first_payment_ts, f.first_subscription_package_ts,
           n.n_name AS country_code, c.c_mktsegment AS focus_countries, r.r_name AS region,
           c.c_acctbal AS projected_gross_margin_360d,
           CASE WHEN f.user_id % 11 = 0 THEN NULL ELSE 'lv' || CAST(f.user_id % 4 AS VARCHAR) END AS language_version,
           (f.user_id % 37 = 0) AS is_staff
    FROM firsts f
    LEFT JOIN customer c ON f.user_id = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
dim_session AS (
    SELECT user_id, ts AS start_ts, CAST(k % 10 AS BIGINT) AS pages_viewed,
           CAST(round(value * 100) AS BIGINT) AS duration_sec,
           CASE WHEN k % 2 = 0 THEN 'v' || CAST(k % 3 AS VARCHAR) END AS app_version
    FROM ev WHERE event_type IN ('view', 'click')
),
tutors_messagethread AS (
    SELECT user_id * 10 + user_id % 3 AS id, user_id, 1000000 + user_id % 7 AS tutor_id
    FROM (SELECT DISTINCT user_id FROM ev WHERE user_id % 5 <> 0)
),
tutors_message AS (
    SELECT user_id * 10 + user_id % 3 AS thread_id,
           CASE WHEN k % 3 = 0 THEN 1000000 + user_id % 7 WHEN k % 3 = 1 THEN user_id END AS author_id,
           ts AS time_posted
    FROM ev WHERE event_type IN ('click', 'error')
),
dim_lesson AS (
    SELECT event_id AS id, user_id AS student_id, ts AS lesson_ts,
           ['COMPLETED', 'AUTOCOMPLETED', 'CANCELLED', 'REFUNDED'][k % 4 + 1] AS lesson_status,
           CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 6 AS DOUBLE) END AS rating_amount
    FROM ev WHERE event_type = 'purchase'
),
fact_payment AS (
    SELECT o_custkey AS user_id,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER)
               AS user_subscription_package_order,
           1 AS tutoring_subscription_package_order,
           CAST(1 + o_orderkey % 20 AS DOUBLE) AS hours,
           o_orderpriority AS subject,
           o_totalprice AS gmv_proceeds_usd
    FROM orders WHERE o_custkey % 13 <> 0
),
fact_event_v2 AS (
    SELECT user_id, ts AS event_ts,
           CASE event_type WHEN 'view' THEN 'search_card_viewed' WHEN 'click' THEN 'search_completed'
                ELSE event_type END AS event_name
    FROM ev
),
agg_daily_subscription_logs AS (
    SELECT l.user_id, l.tutoring_id, l.subscription_log_date,
           s.first_subscription_package_ts AS first_subscription_event_ts, l.subscription_active_day
    FROM (
        SELECT user_id,
               user_id * 10 + CASE WHEN user_id % 4 = 0 THEN event_id % 2 ELSE 0 END AS tutoring_id,
               d AS subscription_log_date,
               bool_or(k % 10 <> 0) AS subscription_active_day
        FROM ev WHERE event_type IN ('view', 'signup')
        GROUP BY 1, 2, 3
    ) l
    LEFT JOIN dim_student s ON l.user_id = s.id
)"""



def rough_roles() -> str:
    """``ROLES`` with calendar gaps, unknown staff flags, shared lesson ids and second
    first packages."""
    changes = {
        "INTERVAL 1 DAY)) AS x FROM ev)\n)": "INTERVAL 1 DAY)) AS x FROM ev) WHERE day(x) % 9 <> 4\n)",
        "(f.user_id % 37 = 0) AS is_staff": "CASE WHEN f.user_id % 41 <> 5 THEN f.user_id % 37 = 0 END AS is_staff",
        "SELECT event_id AS id, user_id AS student_id": "SELECT user_id * 100 + event_id % 3 AS id, user_id AS student_id",
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER)": (
            "CASE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) WHEN 1 THEN 1 "
            "WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END ELSE 3 END AS INTEGER)"
        ),
    }
    out = ROLES
    for old, new in changes.items():
        if old not in out:
            raise ValueError(f"no such role text: {old}")
        out = out.replace(old, new)
    return out


# One ledger holds every dated fact as (student, day, what, amount, item); a feature
# is a conditional total over the ledger between the first subscription and the day.
FEATURES = """
ranges AS (
    SELECT DISTINCT id AS student_id, CAST(first_payment_ts AS DATE) AS paid,
           CAST(first_subscription_package_ts AS DATE) AS subscribed,
           CAST(first_subscription_package_ts AS DATE) + {label_day} AS label_date,
           country_code, focus_countries, region, projected_gross_margin_360d, language_version
    FROM dim_student
    WHERE NOT is_staff AND first_payment_ts IS NOT NULL AND first_subscription_package_ts IS NOT NULL
),
candidates AS (
    SELECT *, CAST(unnest(generate_series(CAST(greatest(paid, subscribed) AS TIMESTAMP), CAST(label_date AS TIMESTAMP),
                                          INTERVAL 1 DAY)) AS DATE) AS date_dt
    FROM ranges
),
spine_days AS (
    SELECT * FROM candidates
    WHERE date_dt IN (SELECT date_dt FROM dim_date) AND date_dt BETWEEN DATE '2023-01-01' AND CURRENT_DATE - 1
    QUALIFY row_number() OVER (PARTITION BY student_id, date_dt ORDER BY paid, subscribed, country_code NULLS FIRST,
        focus_countries NULLS FIRST, region NULLS FIRST, projected_gross_margin_360d NULLS FIRST, language_version NULLS FIRST) = 1
),
active_logs AS (
    SELECT user_id, tutoring_id, subscription_log_date AS day
    FROM agg_daily_subscription_logs
    WHERE subscription_active_day AND tutoring_id IS NOT NULL
      AND subscription_log_date - CAST(first_subscription_event_ts AS DATE) <= {label_day}
),
parallel_users AS (
    SELECT x.user_id FROM active_logs x JOIN active_logs y USING (user_id, day) WHERE x.tutoring_id < y.tutoring_id
),
cohort_spine AS (
    SELECT * FROM spine_days
    WHERE student_id IN (SELECT user_id FROM active_logs) AND student_id NOT IN (SELECT user_id FROM parallel_users)
),
ledger AS (
    SELECT user_id AS student_id, CAST(start_ts AS DATE) AS day, CASE WHEN app_version IS NULL THEN 'web' ELSE 'app' END || ' pages' AS what,
           CAST(pages_viewed AS DOUBLE) AS amount, CAST(NULL AS BIGINT) AS item
    FROM dim_session
    UNION ALL
    SELECT user_id, CAST(start_ts AS DATE), CASE WHEN app_version IS NULL THEN 'web' ELSE 'app' END || ' seconds', CAST(duration_sec AS DOUBLE), NULL
    FROM dim_session
    UNION ALL
    SELECT student_id, CAST(lesson_ts AS DATE), 'lesson', coalesce(rating_amount, 0), id
    FROM dim_lesson WHERE lesson_status LIKE '%COMPLETED'
    UNION ALL
    SELECT t.user_id, CAST(m.time_posted AS DATE), CASE m.author_id WHEN t.user_id THEN 'student message' ELSE 'tutor message' END, 1, NULL
    FROM tutors_messagethread t JOIN tutors_message m ON m.thread_id = t.id AND m.author_id IN (t.user_id, t.tutor_id)
    UNION ALL
    SELECT user_id, CAST(event_ts AS DATE), event_name, 1, NULL FROM fact_event_v2
),
book AS (
    SELECT c.student_id, c.date_dt, l.day, l.what, l.amount, l.item
    FROM cohort_spine c LEFT JOIN ledger l ON l.student_id = c.student_id AND l.day BETWEEN c.subscribed AND c.date_dt
),
totals AS (
    SELECT student_id, date_dt,
           {session_totals},
           CAST(count(DISTINCT day) FILTER (WHERE what LIKE '%seconds') AS BIGINT) AS days_with_session,
           CAST(date_dt - max(day) FILTER (WHERE what LIKE '%seconds') AS INTEGER) AS days_since_last_session,
           max(day) FILTER (WHERE what = 'lesson') AS last_confirmed_lesson_date,
           CAST(date_dt - max(day) FILTER (WHERE what = 'lesson') AS INTEGER) AS n_days_since_last_confirmed_lesson,
           count(DISTINCT item) FILTER (WHERE what = 'lesson') AS num_confirmed_lessons_during_sub,
           coalesce(sum(amount) FILTER (WHERE what = 'lesson') / count(*) FILTER (WHERE what = 'lesson'), 0) AS avg_lesson_rating,
           count(*) FILTER (WHERE what = 'student message') AS student_messages_sent,
           count(*) FILTER (WHERE what = 'tutor message') AS tutor_messages_sent,
           count(*) FILTER (WHERE what = 'search_completed') AS num_search_page_views,
           count(*) FILTER (WHERE what = 'search_card_viewed') AS num_impressions
    FROM book GROUP BY student_id, date_dt
),
days_status AS (
    SELECT user_id, subscription_log_date AS day, bool_and(subscription_active_day) AS every_one, bool_or(subscription_active_day) AS any_one
    FROM agg_daily_subscription_logs GROUP BY ALL
),
statuses AS (
    SELECT c.student_id, c.date_dt,
           (SELECT every_one FROM days_status s WHERE s.user_id = c.student_id AND s.day = c.date_dt) AS subscription_active_day,
           NOT coalesce((SELECT any_one FROM days_status s WHERE s.user_id = c.student_id AND s.day = c.label_date), false) AS churn_day_33
    FROM cohort_spine c
),
packages AS (
    SELECT user_id, min(struct_pack(h := hours, s := subject, g := gmv_proceeds_usd)) AS p
    FROM fact_payment WHERE user_subscription_package_order = 1 AND tutoring_subscription_package_order = 1 GROUP BY user_id
),
paid_packages AS (
    SELECT c.student_id, c.date_dt, p.h AS hours, p.s AS subject, p.g AS gmv_proceeds_usd
    FROM cohort_spine c LEFT JOIN packages ON user_id = c.student_id
),
training AS (
    SELECT {columns}
    FROM (SELECT *, paid AS first_payment_date, subscribed AS first_sub_payment_date, CAST(date_dt - paid AS INTEGER) AS student_age,
                 CAST(date_dt - subscribed AS INTEGER) AS days_since_first_sub_payment FROM cohort_spine)
    JOIN totals USING (student_id, date_dt) JOIN statuses USING (student_id, date_dt) JOIN paid_packages USING (student_id, date_dt)
)"""

#: Names of the session totals: (suffix of the ledger's kind, which rows, column names of sum and average).
SESSION_TOTALS = [
    ("pages", "%", "sum_pages_viewed_all", "avg_pages_viewed_all"),
    ("seconds", "%", "sum_session_duration_all", "avg_session_duration_all"),
    ("pages", "app", "sum_page_viewed_app", "avg_page_viewed_app"),
    ("seconds", "app", "sum_session_duration_app", "avg_session_duration_app"),
    ("pages", "web", "sum_page_viewed_non_app", "avg_page_viewed_non_app"),
    ("seconds", "web", "sum_session_duration_non_app", "avg_session_duration_non_app"),
]


def _session_totals() -> str:
    out = []
    for kind, where, total, mean in SESSION_TOTALS:
        rows = f"FILTER (WHERE what LIKE '{where} {kind}')"
        out.append(f"CAST(sum(amount) {rows} AS BIGINT) AS {total}")
        out.append(f"sum(amount) {rows} / nullif(count(amount) {rows}, 0) AS {mean}")
    return ", ".join(out)


def features(label_day: int) -> str:
    return FEATURES.format(label_day=label_day, session_totals=_session_totals(), columns=", ".join(TRAINING_COLUMNS))


def with_roles(body: str, label_day: int = FIXTURE_LABEL_DAY, feature_ctes: bool = True) -> str:
    ctes = ROLES + ("," + features(label_day) if feature_ctes else "")
    return f"WITH {ctes}\n{body}"


SPINE_COLS = (
    "student_id, date_dt, paid AS first_payment_date, CAST(date_dt - paid AS INTEGER) AS student_age, "
    "subscribed AS first_sub_payment_date, CAST(date_dt - subscribed AS INTEGER) AS days_since_first_sub_payment, "
    "country_code, focus_countries, region, projected_gross_margin_360d, language_version"
)


def relational_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["read_table"] = with_roles("SELECT * FROM dim_lesson", feature_ctes=False)
    q["read_filtered"] = with_roles(
        "SELECT * FROM dim_lesson WHERE lesson_status IN ('COMPLETED', 'AUTOCOMPLETED')", feature_ctes=False
    )
    q["read_query"] = with_roles(
        "SELECT user_id, count(*) AS n_sessions, CAST(sum(pages_viewed) AS BIGINT) AS pages "
        "FROM dim_session WHERE app_version IS NOT NULL GROUP BY user_id",
        feature_ctes=False,
    )
    q["read_external"] = (
        "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event, max(value) AS top_value FROM events "
        "WHERE event_type IN ('purchase', 'signup') AND user_id >= 20 AND user_id <> 33 AND value > 10.5 GROUP BY ALL"
    )
    q["spine"] = with_roles(f"SELECT {SPINE_COLS} FROM spine_days")
    q["single_sub_cohort"] = with_roles(f"SELECT {SPINE_COLS} FROM cohort_spine")
    for name, columns in (("session", SESSION_COLUMNS), ("message", MESSAGE_COLUMNS), ("lesson", LESSON_COLUMNS), ("search", SEARCH_COLUMNS)):
        q[f"{name}_features"] = with_roles(f"SELECT student_id, date_dt, {', '.join(columns)} FROM totals")
    q["payment_features"] = with_roles("SELECT * FROM paid_packages")
    q["status_label"] = with_roles("SELECT * FROM statuses")
    q["training_table"] = with_roles("SELECT * FROM training")
    q["training_table_bucketed"] = q["training_table"]
    q["training_table_rough"] = q["training_table"].replace(ROLES, rough_roles())
    q["lesson_features_rough"] = q["lesson_features"].replace(ROLES, rough_roles())
    return q


# ---------------------------------------------------------------------------
# Modelling side: model frame, split, balance, rule scores, metrics.

RULES = {
    "score_recency": (30, {"days_since_last_session": 3, "n_days_since_last_confirmed_lesson": 2,
                           "num_confirmed_lessons_during_sub": -4}),
    "score_engagement": (70, {"days_with_session": -2, "student_messages_sent": -3, "num_search_page_views": -1,
                              "days_since_first_sub_payment": 1}),
}


def _model_select() -> str:
    cols = []
    for c in MODEL_COLUMNS:
        if c in NUMERIC_FEATURES:
            cols.append(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}")
        elif c in CATEGORICAL_FEATURES:
            cols.append(f"COALESCE(CAST({c} AS VARCHAR), 'empty') AS {c}")
        else:
            cols.append(c)
    return "student_id, " + ", ".join(cols) + ", churn_day_33"


def _rule_sql(name: str) -> str:
    bias, weights = RULES[name]
    s = f"CAST({bias} AS DOUBLE)" + "".join(f" + ({w}) * CAST({c} AS DOUBLE)" for c, w in weights.items())
    return (
        f"SELECT days_since_first_sub_payment AS horizon, '{name}' AS model, student_id, churn_day_33 AS label, "
        f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {s})) / 100.0::DOUBLE AS p_churn FROM test_rows"
    )


MODEL = """,
model_rows AS (
    SELECT {model_select} FROM training
    WHERE subscription_active_day IS TRUE AND days_since_first_sub_payment IN (7, 14, 21)
),
split AS (
    SELECT *, (CAST('0x' || substr(md5('123:' || CAST(student_id AS VARCHAR)), 1, 7) AS BIGINT) % 100 < 33) AS is_test
    FROM model_rows
),
train_rows AS (SELECT * FROM split WHERE NOT is_test),
test_rows AS (SELECT * FROM split WHERE is_test),
class_keep AS (
    SELECT days_since_first_sub_payment AS h,
           least(sum(CASE WHEN churn_day_33 THEN 1 ELSE 0 END), sum(CASE WHEN NOT churn_day_33 THEN 1 ELSE 0 END)) AS keep
    FROM train_rows GROUP BY 1
),
negatives AS (
    SELECT t.*, row_number() OVER (
        PARTITION BY days_since_first_sub_payment
        ORDER BY md5('123:' || CAST(days_since_first_sub_payment AS VARCHAR) || ':' || CAST(student_id AS VARCHAR)), student_id
    ) AS rn
    FROM train_rows t WHERE NOT churn_day_33
),
balanced AS (
    SELECT * FROM train_rows WHERE churn_day_33
    UNION ALL
    SELECT n.* EXCLUDE (rn) FROM negatives n JOIN class_keep c ON n.days_since_first_sub_payment = c.h WHERE n.rn <= c.keep
),
scored AS ({rules}),
predictions AS (SELECT horizon, model, student_id, label, p_churn >= 0.5::DOUBLE AS prediction, p_churn FROM scored),
counts AS (
    SELECT horizon, model,
           CAST(sum(CASE WHEN NOT label AND NOT prediction THEN 1 ELSE 0 END) AS BIGINT) AS tn,
           CAST(sum(CASE WHEN NOT label AND prediction THEN 1 ELSE 0 END) AS BIGINT) AS fp,
           CAST(sum(CASE WHEN label AND NOT prediction THEN 1 ELSE 0 END) AS BIGINT) AS fn,
           CAST(sum(CASE WHEN label AND prediction THEN 1 ELSE 0 END) AS BIGINT) AS tp
    FROM predictions GROUP BY 1, 2
),
metrics AS (
    SELECT horizon, model,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0::DOUBLE) AS precision,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0::DOUBLE) AS recall,
           (CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0)
            + CAST(tn AS DOUBLE) / NULLIF(CAST(tn + fp AS DOUBLE), 0)) / 2.0::DOUBLE AS roc_auc,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0::DOUBLE) AS ref_precision_score,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0::DOUBLE) AS ref_recall_score,
           (CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0)
            + CAST(tn AS DOUBLE) / NULLIF(CAST(tn + fn AS DOUBLE), 0)) / 2.0::DOUBLE AS ref_roc_auc_score
    FROM counts
),
thr AS (SELECT * FROM (VALUES {thresholds}) t(threshold)),
thr_counts AS (
    SELECT p.horizon, p.model, t.threshold,
           sum(CASE WHEN p.label THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN p.label AND p.p_churn >= t.threshold THEN 1 ELSE 0 END) AS tp,
           sum(CASE WHEN p.p_churn >= t.threshold THEN 1 ELSE 0 END) AS flagged
    FROM predictions p CROSS JOIN thr t GROUP BY 1, 2, 3
),
thr_metrics AS (
    SELECT horizon, model, threshold,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(pos AS DOUBLE), 0), 0.0::DOUBLE) AS recall,
           COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(flagged AS DOUBLE), 0), 0.0::DOUBLE) AS precision
    FROM thr_counts
)"""


def with_model(body: str, label_day: int = FIXTURE_LABEL_DAY, extra_cte: str = "") -> str:
    model = MODEL.format(
        model_select=_model_select(),
        rules=" UNION ALL ".join(_rule_sql(n) for n in RULES),
        thresholds=", ".join(f"({float(t)}::DOUBLE)" for t in THRESHOLDS),
    )
    extra = f",\n{extra_cte}" if extra_cte else ""
    return f"WITH {ROLES},{features(label_day)}{model}{extra}\n{body}"


def _pivot(source: str, value: str, columns: list[str], label_expr: str) -> str:
    sel = ", ".join(f'max(CASE WHEN col = \'{c}\' THEN {value} END) AS "{c}"' for c in columns)
    return f"SELECT metric, {sel} FROM (SELECT *, {label_expr} AS col FROM {source}) GROUP BY metric"


def _corr_sql() -> str:
    cols = [c for c in MODEL_COLUMNS if c not in CATEGORICAL_FEATURES] + ["churn_day_33"]
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (
        f"SELECT a.feature AS feature_a, b.feature AS feature_b, "
        f"CASE WHEN isnan(corr(a.v, b.v)) THEN NULL ELSE round(corr(a.v, b.v), 6) END AS corr "
        f"FROM long_rows a JOIN long_rows b ON a.sid = b.sid AND a.h = b.h GROUP BY 1, 2"
    ), (
        f"long_rows AS (UNPIVOT (SELECT student_id AS sid, days_since_first_sub_payment AS h, {sel} FROM model_rows) "
        f"ON COLUMNS(* EXCLUDE (sid, h)) INTO NAME feature VALUE v)"
    )


#: A tree for "level a or level b" splits on the level of larger gain, then the rows
#: without it on the other; a feature's importance is its gain times its rows.
TWO_COLUMNS = """
SELECT horizon, CAST(row_number() OVER (PARTITION BY horizon ORDER BY share DESC, feature_name) AS INTEGER) AS rank,
       feature_name, share AS feature_importances
FROM (
    SELECT horizon, feature_name, round(raw / sum(raw) OVER (PARTITION BY horizon), 6) AS share
    FROM (
        SELECT h AS horizon, unnest(['language_version=lv2', 'region=ASIA']) AS feature_name,
               unnest(CASE WHEN a_first >= b_first THEN [a_first, without_a] ELSE [without_b, b_first] END) AS raw
        FROM (
            SELECT h, whole - without_a AS a_first, without_a, whole - without_b AS b_first, without_b
            FROM (
                SELECT h, 2 * pos * (n - pos) / n AS whole,
                       coalesce(2 * (pos - a) * (n - pos) / nullif(n - a, 0), 0) AS without_a,
                       coalesce(2 * (pos - b) * (n - pos) / nullif(n - b, 0), 0) AS without_b
                FROM (
                    SELECT days_since_first_sub_payment AS h, CAST(count(*) AS DOUBLE) AS n,
                           CAST(count(*) FILTER (WHERE language_version = 'lv2' OR region = 'ASIA') AS DOUBLE) AS pos,
                           CAST(count(*) FILTER (WHERE language_version = 'lv2') AS DOUBLE) AS a,
                           CAST(count(*) FILTER (WHERE region = 'ASIA') AS DOUBLE) AS b
                    FROM train_rows GROUP BY ALL
                )
            )
        )
    )
) WHERE share > 0
"""


def _one_hot_sql() -> str:
    cats = " UNION ALL ".join(
        f"SELECT DISTINCT days_since_first_sub_payment AS h, '{c}' AS col, {c} AS val FROM balanced" for c in CATEGORICAL_FEATURES
    )
    match = " OR ".join(f"(c.col = '{c}' AND t.{c} = c.val)" for c in CATEGORICAL_FEATURES)
    rest = [c for c in MODEL_COLUMNS if c not in CATEGORICAL_FEATURES]
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in rest)
    return (
        f"SELECT t.days_since_first_sub_payment AS horizon, t.student_id, c.col || '=' || c.val AS feature, "
        f"1.0::DOUBLE AS value FROM test_rows t JOIN ({cats}) c ON c.h = t.days_since_first_sub_payment AND ({match}) "
        f"UNION ALL SELECT horizon, student_id, feature, value FROM (UNPIVOT (SELECT days_since_first_sub_payment "
        f"AS horizon, student_id, {sel} FROM test_rows) ON COLUMNS(* EXCLUDE (horizon, student_id)) INTO NAME feature "
        f"VALUE value) WHERE value <> 0"
    )


def model_sql() -> dict[str, str]:
    horizons = (7, 14, 21)
    q: dict[str, str] = {}
    q["model_frame"] = with_model("SELECT * FROM model_rows")
    q["train_test_split"] = with_model("SELECT * FROM split")
    q["balanced_train"] = with_model("SELECT * FROM balanced")
    q["class_counts"] = with_model(
        "SELECT days_since_first_sub_payment, CAST(sum(CASE WHEN churn_day_33 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, "
        "CAST(sum(CASE WHEN NOT churn_day_33 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM train_rows GROUP BY 1"
    )
    body, cte = _corr_sql()
    q["correlation_matrix"] = with_model(body, extra_cte=cte)
    q["one_hot_encoded"] = with_model(_one_hot_sql())
    q["rule_predictions"] = with_model("SELECT * FROM predictions")
    q["confusion_matrix"] = with_model(
        "SELECT horizon, model, a AS actual, p AS predicted, n FROM counts, LATERAL (VALUES "
        "(false, false, tn), (false, true, fp), (true, false, fn), (true, true, tp)) v(a, p, n)"
    )
    q["confusion_table"] = with_model(
        "SELECT horizon, model, r AS row, f AS col_false, t AS col_true FROM counts, LATERAL (VALUES "
        "(false, tn, fp), (true, fn, tp)) v(r, f, t)"
    )
    q["confusion_table_compat"] = with_model(
        "SELECT horizon, model, r AS row, f AS col_false, t AS col_true FROM counts, LATERAL (VALUES "
        "(false, tn, fn), (true, fp, tp)) v(r, f, t)"
    )
    flags = ", ".join(f"p_churn >= {float(t)}::DOUBLE AS thr_{int(round(t * 100))}" for t in THRESHOLDS)
    q["prediction_flags"] = with_model(f"SELECT *, {flags} FROM predictions")
    q["model_metrics"] = with_model("SELECT * FROM metrics")
    ref = {"ref_precision_score": "precision_score", "ref_recall_score": "recall_score",
           "ref_roc_auc_score": "roc_auc_score"}
    long_ref = " UNION ALL ".join(
        f"SELECT horizon, model, '{new}' AS metric, {old} AS value FROM metrics" for old, new in ref.items()
    )
    cols = [f"{m}_{h}" for h in horizons for m in RULES]
    q["metrics_table"] = with_model(_pivot(f"({long_ref})", "value", cols, "model || '_' || CAST(horizon AS VARCHAR)"))
    q["threshold_sweep"] = with_model("SELECT horizon, model, threshold, recall, precision FROM thr_metrics")
    tcols = [f"{int(round(t * 100))}_thr_{h}" for h in horizons for t in THRESHOLDS]
    long_thr = (
        "(SELECT horizon, threshold, 'Recall' AS metric, recall AS value FROM thr_metrics WHERE model = 'score_recency' "
        "UNION ALL SELECT horizon, threshold, 'Precision' AS metric, precision AS value FROM thr_metrics "
        "WHERE model = 'score_recency')"
    )
    q["threshold_table"] = with_model(
        _pivot(long_thr, "value", tcols, "CAST(CAST(round(threshold * 100) AS INTEGER) AS VARCHAR) || '_thr_' || CAST(horizon AS VARCHAR)")
    )
    q["roc_auc"] = with_model(
        "SELECT horizon, model, CAST(u2 - p * (p + 1) AS DOUBLE) / NULLIF(CAST(2 * p * (total - p) AS DOUBLE), 0) AS roc_auc, CAST(0 AS BIGINT) AS n_unscored "
        "FROM (SELECT horizon, model, sum(pos * (lo + hi)) AS u2, sum(pos) AS p, sum(n) AS total FROM ("
        "SELECT horizon, model, p_churn, min(rn) AS lo, max(rn) AS hi, sum(CASE WHEN label THEN 1 ELSE 0 END) AS pos, "
        "count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY horizon, model ORDER BY p_churn) AS rn "
        "FROM predictions) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )
    q["save_reload"] = with_roles("SELECT * FROM training")
    q["save_interrupted"] = with_roles(
        "SELECT 'name' AS reader, count(*) AS n, max(days_since_first_sub_payment) AS last_day FROM training UNION ALL "
        "SELECT 'newest', count(*), max(days_since_first_sub_payment) FROM training WHERE days_since_first_sub_payment <= 7"
    )
    merged = ", ".join(f"NULL AS {c}" if c in SESSION_COLUMNS else c for c in TRAINING_COLUMNS)
    q["save_merge"] = with_roles(f"SELECT {merged} FROM training")
    repeated = with_roles(f"SELECT {SPINE_COLS} FROM spine_days").replace(
        "    FROM dim_student\n    WHERE NOT is_staff",
        "    FROM (SELECT * FROM dim_student UNION ALL SELECT * REPLACE (first_subscription_package_ts + INTERVAL 4 DAY "
        "AS first_subscription_package_ts) FROM dim_student WHERE id % 3 = 0)\n    WHERE NOT is_staff",
    )
    q["spine_repeated_students"] = repeated
    q["payment_order_without_dates"] = (
        "SELECT o_orderkey, o_custkey, o_day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_day NULLS FIRST, o_orderkey) AS order_no "
        "FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS o_day FROM orders)"
    )
    gappy = (
        "gappy AS (SELECT * REPLACE (CASE student_id % 9 WHEN 1 THEN NULL WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN p_churn + 1.5::DOUBLE "
        "ELSE p_churn END AS p_churn) FROM predictions)"
    )
    # wins of churners over non-churners, counted pair by pair
    q["roc_auc_gaps"] = with_model(
        "SELECT g.horizon, g.model, w.won / NULLIF(CAST(g.p * g.n AS DOUBLE), 0) AS roc_auc, g.n_unscored FROM ("
        "SELECT horizon, model, count(*) FILTER (WHERE label AND p_churn IS NOT NULL) AS p, "
        "count(*) FILTER (WHERE NOT label AND p_churn IS NOT NULL) AS n, count(*) FILTER (WHERE p_churn IS NULL) AS n_unscored "
        "FROM gappy GROUP BY ALL) g LEFT JOIN (SELECT a.horizon, a.model, sum(CASE WHEN a.p_churn > b.p_churn THEN 1.0::DOUBLE "
        "WHEN a.p_churn = b.p_churn THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS won FROM gappy a JOIN gappy b USING (horizon, model) "
        "WHERE a.label AND NOT b.label AND a.p_churn IS NOT NULL AND b.p_churn IS NOT NULL GROUP BY ALL) w USING (horizon, model)",
        extra_cte=gappy,
    )
    sure = ", ".join(
        f"coalesce(NOT isnan(p_churn) AND p_churn >= {float(t)}::DOUBLE, false) AS thr_{int(round(t * 100))}" for t in THRESHOLDS
    )
    q["prediction_flags_gaps"] = with_model(f"SELECT horizon, model, student_id, label, {sure} FROM gappy", extra_cte=gappy)
    ruled = "language_version = 'lv2'"
    for key, name in (("logistic", "logistic_regression"), ("tree", "decision_tree"), ("gbt", "gradient_boosting")):
        q[f"fit_{key}_rule"] = with_model(
            f"SELECT days_since_first_sub_payment AS horizon, '{name}' AS model, student_id, {ruled} AS label, {ruled} AS prediction FROM test_rows"
        )
    q["feature_importance_rule"] = with_model(
        "SELECT DISTINCT days_since_first_sub_payment AS horizon, 'language_version=lv2' AS feature_name, "
        "1.0::DOUBLE AS feature_importances FROM train_rows"
    )
    q["feature_importance_boosted_rule"] = with_model(
        "SELECT DISTINCT days_since_first_sub_payment AS horizon, CAST(1 AS INTEGER) AS rank, 'language_version=lv2' AS feature_name, "
        "1.0::DOUBLE AS feature_importances FROM train_rows"
    )
    q["feature_importance_two_columns"] = with_model(TWO_COLUMNS)
    # leaves of two levels, or one leaf if both would get the same class
    q["tree_probability"] = with_model(
        "SELECT h AS horizon, student_id, churn_day_33 AS label, p > 0.5::DOUBLE AS prediction, p AS p_churn FROM ("
        "SELECT t.days_since_first_sub_payment AS h, t.student_id, t.churn_day_33, "
        "CASE WHEN s.n2 = 0 OR s.n = s.n2 OR (s.k2 / s.n2 > 0.5::DOUBLE) = ((s.k - s.k2) / (s.n - s.n2) > 0.5::DOUBLE) THEN s.k / s.n "
        "WHEN t.language_version = 'lv2' THEN s.k2 / s.n2 ELSE (s.k - s.k2) / (s.n - s.n2) END AS p "
        "FROM test_rows t JOIN (SELECT days_since_first_sub_payment AS h, CAST(count(*) AS DOUBLE) AS n, "
        "CAST(count(*) FILTER (WHERE churn_day_33) AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE language_version = 'lv2') AS DOUBLE) AS n2, "
        "CAST(count(*) FILTER (WHERE churn_day_33 AND language_version = 'lv2') AS DOUBLE) AS k2 FROM balanced GROUP BY ALL) s "
        "ON s.h = t.days_since_first_sub_payment)"
    )
    numeric = ", ".join(f"'{c}'" for c in MODEL_COLUMNS if c not in CATEGORICAL_FEATURES)
    levels = " UNION ALL ".join(f"SELECT days_since_first_sub_payment AS horizon, '{c}=' || {c} AS feature_name FROM balanced" for c in CATEGORICAL_FEATURES)
    q["logistic_optimality"] = with_model(
        f"SELECT DISTINCT horizon, feature_name, true AS within_bound FROM ({levels} UNION ALL "
        f"SELECT days_since_first_sub_payment, unnest([{numeric}, '(intercept)']) FROM balanced)"
    )
    return q


def all_sql() -> dict[str, str]:
    return {**relational_sql(), **model_sql()}
