"""Tables as versioned snapshots, published in one atomic step.

A table has a root folder:

* ``data/<version>-<mark>/``: the rows of one snapshot, never changed once written,
* ``versions/<version>.json``: one small manifest for each published version.

The highest manifest is the table. A save writes its rows to a folder of its own, then
publishes by putting the next manifest in place, which fails if that version exists:
of two writers that started from the same version one gets ``PublishConflict`` and none
of its rows is seen. The catalog name is a view on one snapshot's table; it is pointed
at the new snapshot after publication, by one change of one catalog entry. Whatever
step a job dies at, the name reads a whole snapshot, old or new; the next save (or
``repair``) moves it on. The last ``KEEP`` versions stay for readers that began on them.

Publication needs a file system that can put a file in place only if none is there: a
hard link on a local disk, a rename that refuses an existing target elsewhere (HDFS and
stores with such a rename). No lock and no service beside the catalog is needed.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KEEP = 2
ROOT_PROPERTY = "attrition.snapshots.root"


class PublishConflict(RuntimeError):
    """Another writer has published the version that this save wanted to."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    table: str  # catalog table of the snapshot's rows
    data: str  # its folder
    schema: str  # JSON

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(root: str, version: int) -> str:
    return f"{root}/versions/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    where, fs = _path(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """A published snapshot, by default the newest; None if nothing was published."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    where, fs = _path(spark, _manifest(root, version))
    stream = fs.open(where)
    try:
        return Snapshot(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a snapshot, whatever the catalog name points at."""
    found = snapshot(spark, root, version)
    if found is None:
        raise ValueError(f"no snapshot below {root}")
    return spark.read.schema(found.struct()).parquet(found.data)


def publish(spark: SparkSession, root: str, new: Snapshot) -> None:
    """Put the manifest of ``new`` in place, or raise ``PublishConflict``."""
    target = _manifest(root, new.version)
    draft = f"{root}/versions/draft-{uuid.uuid4().hex}"
    where, fs = _path(spark, draft)
    out = fs.create(where, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    conflict = PublishConflict(f"version {new.version} of {root} was published by another writer; this save is not visible")
    try:
        if fs.getScheme() == "file":
            try:
                os.link(urlparse(draft).path, urlparse(target).path)
            except FileExistsError:
                raise conflict from None
        else:
            _rename_unless_there(spark, draft, target, conflict)
    finally:
        fs.delete(where, False)


def _rename_unless_there(spark: SparkSession, source: str, target: str, conflict: PublishConflict) -> None:
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(a, b, options)  # without the option to overwrite
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in failed.java_exception.getClass().getName():
            raise conflict from None
        raise


def point(spark: SparkSession, name: str, root: str, to: Snapshot) -> None:
    """Let the catalog name read ``to``."""
    former = spark.catalog.getTable(name) if spark.catalog.tableExists(name) else None
    if former is not None and former.tableType != "VIEW":
        # a plain table saved by others takes a new name once; ``repair`` helps if a job dies here
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__before_snapshots_{uuid.uuid4().hex[:8]}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{ROOT_PROPERTY}' = '{root}') AS SELECT * FROM {to.table}")


def root_of(spark: SparkSession, name: str) -> str | None:
    """Root folder of a name that this module points, None for any other."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where(f"key = '{ROOT_PROPERTY}'").collect()
    return rows[0].value if rows else None


def repair(spark: SparkSession, name: str, root: str | None = None) -> Snapshot:
    """Point ``name`` at the newest published snapshot (a job may have died between
    publishing it and moving the name)."""
    root = root or root_of(spark, name)
    newest = snapshot(spark, root) if root else None
    if newest is None:
        raise ValueError(f"{name} has no published snapshot")
    point(spark, name, root, newest)
    return newest


def default_root(spark: SparkSession, name: str) -> str:
    """Root of a table that is given no path: beside the tables of its database."""
    database, _, table = name.rpartition(".")
    place = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{place.rstrip('/')}/{table}__snapshots"


def save(df: DataFrame, name: str, root: str, base: Snapshot | None, partition_by: list[str] | None = None, keep: int = KEEP) -> Snapshot:
    """Write ``df`` as the version after ``base``, publish it and move the name on."""
    spark = df.sparkSession
    version = base.version + 1 if base else 1
    mark = uuid.uuid4().hex[:12]
    new = Snapshot(version, f"{name}__snapshot_{version}_{mark}", f"{root}/data/{version:020d}-{mark}", df.schema.json())
    writer = df.write.mode("errorifexists").option("path", new.data)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(new.table)
        publish(spark, root, new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new.table}")
        where, fs = _path(spark, new.data)
        fs.delete(where, True)
        raise
    point(spark, name, root, new)
    prune(spark, root, keep)
    return new


def prune(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Remove all but the last ``keep`` versions: first the manifest, then the rows."""
    for version in versions(spark, root)[: -max(1, keep)]:
        old = snapshot(spark, root, version)
        for path, deep in ((_manifest(root, version), False), (old.data, True)):
            where, fs = _path(spark, path)
            if not deep:
                fs.delete(where, False)
            else:
                spark.sql(f"DROP TABLE IF EXISTS {old.table}")
                fs.delete(where, True)
