"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the engine relies on. Time zone: dates are taken from
# TIMESTAMP_NTZ columns, but UTC keeps any zoned timestamp stable as well.
# requireAllClusterKeysForCoPartition=false lets joins on (student_id, date_dt)
# reuse a student_id hash partitioning instead of shuffling both sides again.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# Settings for the batch jobs on a cluster at the target scale (~100 TB of
# facts). Scans split at 1 GB (100,000 map tasks; they aggregate as they read);
# shuffles start at 4,000 partitions and AQE coalesces them to
# ~256 MB partitions (size first, not parallelism first, on a shared cluster),
# so a partition fits an executor's memory with room to sort. The daily
# pre-aggregates are far smaller than the raw facts, so after the first
# exchange most partitions are coalesced away. Skewed join partitions above
# 5x the median and 512 MB are split.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "1g",
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
}


def apply_cluster_conf(spark: SparkSession) -> None:
    """Engine settings plus the cluster sizing above, each only where the session
    has not set it."""
    apply_engine_conf(spark)
    set_unset(spark, CLUSTER_CONF)


def set_unset(spark: SparkSession, conf: dict[str, str]) -> None:
    """Set the keys that neither the session nor the application has set."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    own = {r.key for r in spark.sql("SET").collect()}
    for key, value in conf.items():
        if key not in given and key not in own:
            spark.conf.set(key, value)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "attrition") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Local runs: keep small shuffles split across the cores instead of
        # coalescing them into one task (clusters keep their own settings).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Engine settings where unset; in local mode also one shuffle partition a core,
    since Spark's default of 200 is sized for a cluster."""
    sc = spark.sparkContext
    local = {"spark.sql.shuffle.partitions": str(sc.defaultParallelism)} if sc.master.startswith("local") else {}
    set_unset(spark, ENGINE_CONF | local)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir`` (the cluster's shared folder). Only
    when the session names none (local tests) a private folder is created. The
    application's own checkpoints (Spark keeps them in a folder made for it) are
    removed when the driver's JVM ends.
    """
    root = _checkpoint_root(spark)
    own = spark.sparkContext.getCheckpointDir()
    if own and own not in _REMOVED_AT_EXIT:
        _REMOVED_AT_EXIT.add(own)
        delete_on_exit(spark, own)
    return root


_REMOVED_AT_EXIT: set[str] = set()


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or S3)")
    local = tempfile.mkdtemp(prefix="attrition-ckpt-")  # local mode only: driver and executors share it
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/attrition/{name}-{uuid.uuid4().hex[:12]}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path`` when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    checkpoint_root(spark)
