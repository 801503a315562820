"""Session helpers: settings the engine touches and the shared checkpoint folder."""

from __future__ import annotations

from attrition.session import apply_engine_conf, checkpoint_root, scratch_path


def test_explicit_shuffle_partitions_are_kept(spark):
    apply_engine_conf(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_checkpoint_root_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    root = checkpoint_root(spark)
    if configured:
        assert root == configured.rstrip("/")
    assert spark.sparkContext.getCheckpointDir()
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root)


def test_checkpoints_go_when_the_application_ends(tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
from attrition.session import build_session, ensure_checkpoint_dir, scratch_path
from pyspark.sql import SparkSession
SparkSession.builder.config("spark.checkpoint.dir", "{tmp_path}/shared").master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark = build_session("local[1]", 1)
ensure_checkpoint_dir(spark)
spark.range(5).checkpoint(eager=True)
import os
assert any(f for _, _, files in os.walk("{tmp_path}/shared") for f in files)
spark.stop()
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": repo}, timeout=200, capture_output=True)
    assert not [f for _, _, files in os.walk(f"{tmp_path}/shared") for f in files]
