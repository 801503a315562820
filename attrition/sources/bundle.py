"""The nine source relations of the churn workload, as one bundle."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from attrition.sources.tables import read_table

# Warehouse names of the sources (fixed by the workload; override per site).
DEFAULT_TABLES = {
    "dim_date": "dim_date",
    "dim_student": "dim_student",
    "subscription_logs": "agg_daily_subscription_logs",
    "sessions": "dim_session",
    "message_threads": "tutors_messagethread",
    "messages": "tutors_message",
    "lessons": "dim_lesson",
    "payments": "fact_payment",
    "events": "fact_event_v2",
}


@dataclass
class ChurnSources:
    dim_date: DataFrame
    dim_student: DataFrame
    subscription_logs: DataFrame
    sessions: DataFrame
    message_threads: DataFrame
    messages: DataFrame
    lessons: DataFrame
    payments: DataFrame
    events: DataFrame

    @classmethod
    def from_catalog(cls, spark: SparkSession, tables: dict[str, str] | None = None) -> "ChurnSources":
        names = {**DEFAULT_TABLES, **(tables or {})}
        return cls(**{f.name: read_table(spark, names[f.name]) for f in fields(cls)})

    @classmethod
    def from_source(
        cls, spark: SparkSession, fmt: str, options: dict[str, str], tables: dict[str, str] | None = None
    ) -> "ChurnSources":
        """Read the sources from an external system (e.g. ``fmt="jdbc"``) through its query option."""
        names = {**DEFAULT_TABLES, **(tables or {})}
        return cls(**{f.name: read_table(spark, names[f.name], fmt=fmt, options=options) for f in fields(cls)})

    def register(self, tables: dict[str, str] | None = None) -> None:
        """Expose the bundle under the warehouse names as temp views."""
        names = {**DEFAULT_TABLES, **(tables or {})}
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(names[f.name])
