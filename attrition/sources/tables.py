"""Reads and writes of warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attrition.config import HORIZON_COL, HORIZONS
from attrition.sources import files_source, snapshots


def read_table(
    spark: SparkSession,
    table_name: str | None = None,
    condition: str | None = None,
    query: str | None = None,
    fmt: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Whole table (S1), table with a predicate (S2) or a query (S3).

    Argument precedence is the reference's: a ``query`` wins over the other two
    arguments. A ``condition`` without a table has nothing to read: ValueError
    (the reference would send an empty query to the warehouse).

    Catalog tables (``fmt`` None): the predicate is a Spark SQL expression and
    Catalyst pushes it into the scan; a query runs through ``spark.sql``.
    External sources (``fmt``, e.g. "jdbc", with connection ``options``): the
    statement goes to the source as its ``query`` option, so the predicate or
    the whole query runs there, as in the reference. A source that takes filters but
    no statements (``files_source.FORMAT``) gets the table's name, and Spark hands it
    the predicate.
    """
    if table_name is None and query is None:
        raise ValueError("read_table needs a table_name or a query")
    if fmt == files_source.FORMAT:
        if query is not None:
            raise ValueError(f"format {fmt} takes a table and a condition, no query")
        files_source.register(spark)
        df = spark.read.format(fmt).options(**(options or {})).option("table", table_name).load()
        return df.where(F.expr(condition)) if condition is not None else df
    if fmt is not None:
        if query is None:
            query = f"select * from {table_name}" + (f" WHERE {condition}" if condition is not None else "")
        return spark.read.format(fmt).options(**(options or {})).option("query", query).load()
    if query is not None:
        return spark.sql(query)
    df = spark.table(table_name)
    if condition is not None:
        df = df.where(F.expr(condition))
    return df


def training_rows(
    training: DataFrame,
    horizons: Iterable[int] = HORIZONS,
) -> DataFrame:
    """Rows the models learn from (S4): active that day and on a horizon day.

    ``subscription_active_day IS TRUE`` drops null status as well as FALSE.
    """
    return training.where(F.col("subscription_active_day").eqNullSafe(True)).where(
        F.col(HORIZON_COL).isin(*[int(h) for h in horizons])
    )


def _aligned(df: DataFrame, name: str, old: StructType) -> DataFrame:
    """Old schema ∪ new schema: columns only the stored table has come back as typed
    nulls. A column that both have must keep its type: ValueError otherwise."""
    new = {f.name.lower(): f for f in df.schema.fields}
    changed = [f for f in old.fields if f.name.lower() in new and new[f.name.lower()].dataType != f.dataType]
    if changed:
        said = ", ".join(f"{f.name}: stored {f.dataType.simpleString()}, new {new[f.name.lower()].dataType.simpleString()}" for f in changed)
        raise ValueError(f"cannot merge schemas of {name}: {said}")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.fields if f.name.lower() not in new]
    return df.select(*df.columns, *missing) if missing else df


def save_training_table(
    df: DataFrame,
    name: str,
    merge_schema: bool = True,
    path: str | None = None,
    partition_by: list[str] | None = None,
) -> snapshots.Snapshot:
    """Overwrite a table (S5): its rows become the next snapshot (``sources.snapshots``).

    With ``merge_schema`` the written schema is the old one widened by the new
    columns, which is what ``mergeSchema`` promises; on plain parquet tables
    Spark would silently drop the old columns.

    Readers of ``name`` see the old rows until the save is published, then the new
    ones; a job that fails or dies on the way leaves the old ones. If another writer
    publishes in between, ``snapshots.PublishConflict`` is raised and nothing of this
    save is visible. ``path``: folder of the snapshots (default: beside the tables of
    the database; a name that was saved before keeps its folder).
    """
    spark = df.sparkSession
    root = (path or snapshots.root_of(spark, name) or snapshots.default_root(spark, name)).rstrip("/")
    base = snapshots.snapshot(spark, root)
    if merge_schema:
        if base is not None:
            df = _aligned(df, name, base.struct())
        elif spark.catalog.tableExists(name):
            df = _aligned(df, name, spark.table(name).schema)
    return snapshots.save(df, name, root, base, partition_by)
