"""The training table from bucketed tables: joins and windows without a shuffle.

``publish`` stores the sources once, hashed into the same number of buckets by student:

* students and subscription logs as they are,
* all other sources as one rollup: their reduced rows per (student, day), and each
  student's first payment.

Raw facts are not bucketed: a bucket is read by one task, and a student with a third of
all facts would fill one. The rollup holds a few rows for each day of a student, whatever
the student did, and is as long as the facts are once reduced.

``build`` then makes the training table of any cohort, horizon and date range from the
tables. Cohort, spine, window bound, first payment and running window all work on
students, whose rows lie in one bucket of each table, so no row of them is exchanged;
only the calendar is (one row a day, broadcast). What changes daily is appended by
publishing again; many training tables are built from one rollup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import TRAINING_COLUMNS, ChurnConfig
from attrition.operators import accumulate as acc
from attrition.operators import facts
from attrition.operators.spine import eligible_students, single_sub_cohort, spine_from_students
from attrition.plans.training_table import dated_rows
from attrition.session import set_unset
from attrition.sources.bundle import ChurnSources

#: A bucketed scan keeps its buckets only if Spark does not think them useless, and a
#: union of co-partitioned rows stays partitioned.
BUCKET_CONF = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.unionOutputPartitioning": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

LABEL_DAY_PROPERTY = "attrition.label_day"
DATED = ("sessions", "lessons", "messages", "search", "status")


@dataclass(frozen=True)
class BucketedTables:
    """Names of the tables of one publication."""

    prefix: str

    def label_day(self, spark: SparkSession) -> int:
        """Label day that the rollup was made for."""
        rows = spark.sql(f"SHOW TBLPROPERTIES {self.prefix}_rollup").where(f"key = '{LABEL_DAY_PROPERTY}'").collect()
        if not rows:
            raise ValueError(f"{self.prefix}_rollup is no published rollup")
        return int(rows[0].value)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(f"{self.prefix}_{name}")


def publish(src: ChurnSources, prefix: str, path: str, n_buckets: int, cfg: ChurnConfig = ChurnConfig()) -> BucketedTables:
    """Write the bucketed tables ``<prefix>_<name>`` below ``path``, over former ones."""
    spark = src.dim_date.sparkSession
    daily = facts.daily(dated_rows(src, DATED, None, cfg), DATED)
    rollup = daily.unionByName(facts.payment_per_student(src.payments), allowMissingColumns=True)
    bucketed = {
        "student": (src.dim_student, "id"),
        "subscription_log": (src.subscription_logs, "user_id"),
        "rollup": (rollup, "student_id"),
    }
    for name, (rows, key) in bucketed.items():
        # dealt as the buckets are, so that a task writes one file of one bucket
        writer = rows.repartition(n_buckets, F.col(key)).write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key)
        writer.option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")
    spark.sql(f"ALTER TABLE {prefix}_rollup SET TBLPROPERTIES ('{LABEL_DAY_PROPERTY}' = '{cfg.label_day}')")
    src.dim_date.write.mode("overwrite").option("path", f"{path}/calendar").saveAsTable(f"{prefix}_calendar")
    return BucketedTables(prefix)


def build(spark: SparkSession, tables: BucketedTables, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    """The 38-column training table from published tables. The rollup's lesson rows
    are those of one label day; another one needs another publication: ValueError."""
    made_for = tables.label_day(spark)
    if cfg.label_day != made_for:
        raise ValueError(f"tables {tables.prefix}_* were published for label day {made_for}, not {cfg.label_day}")
    set_unset(spark, BUCKET_CONF)
    cohort = single_sub_cohort(eligible_students(tables.table(spark, "student")), tables.table(spark, "subscription_log"), cfg.label_day)
    spine = spine_from_students(cohort, tables.table(spark, "calendar"), cfg.calendar_start, cfg.as_of, cfg.label_day)
    bounds = cohort.select("student_id", "first_sub_payment_date").distinct()
    rows = facts.within_window(tables.table(spark, "rollup"), bounds, cfg.label_day)
    return acc.accumulate(spine, [rows], acc.ALL_GROUPS).select(*TRAINING_COLUMNS)


__all__ = ["BUCKET_CONF", "BucketedTables", "build", "publish"]
