"""A source outside the catalog that takes filters (S2): a folder of Parquet tables.

``spark.read.format("attrition_files")`` reads ``<root>/<table>.parquet`` (a file or a
folder of files) without a catalog and without Spark's own reader, as one would read
from a store of another system. Options: ``root``, ``table`` and ``columns`` (comma list,
default all). Comparisons that Spark can hand over (``=``, ``<``, ``IN``, ``IS NULL``, ...
and their negations, joined by AND) are evaluated at the source, which skips row groups
by their statistics and sends only rows that pass; the rest stays with Spark. Floating
columns only take null tests there, since NaN compares otherwise than in Spark.

A partition is a file; nothing but file names comes to the driver. Needs
``spark.sql.python.filterPushdown.enabled`` (``register`` sets it where unset).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, MapType, StructType, TimestampType

from attrition.session import set_unset

FORMAT = "attrition_files"

_COMPARE = {
    api.EqualTo: lambda c, v: c == v,
    api.GreaterThan: lambda c, v: c > v,
    api.GreaterThanOrEqual: lambda c, v: c >= v,
    api.LessThan: lambda c, v: c < v,
    api.LessThanOrEqual: lambda c, v: c <= v,
    api.In: lambda c, v: c.isin([x for x in v if x is not None]),
}
_INEXACT = (FloatType, DoubleType, TimestampType, BinaryType, ArrayType, MapType, StructType)


def _dataset(root: str, table: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    path = f"{root.rstrip('/')}/{table}.parquet"
    if "://" in path or path.startswith("file:"):
        system, path = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    else:
        system = fs.LocalFileSystem()
    return ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)


@dataclass
class FilePartition(api.InputPartition):
    path: str


class FilesReader(api.DataSourceReader):
    """Reads the wanted columns of the rows that pass the filters taken over."""

    def __init__(self, schema: StructType, root: str, table: str):
        self.schema, self.root, self.table = schema, root, table
        self.taken: list[api.Filter] = []

    def _takes(self, f: api.Filter) -> bool:
        if isinstance(f, api.Not):
            return not isinstance(f.child, api.Not) and self._takes(f.child)
        if type(f) not in _COMPARE and not isinstance(f, api.IsNull | api.IsNotNull):
            return False
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return False
        return isinstance(f, api.IsNull | api.IsNotNull) or not isinstance(self.schema[f.attribute[0]].dataType, _INEXACT)

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for f in filters:
            if self._takes(f):
                self.taken.append(f)
            else:
                yield f

    def expression(self):
        """The filters taken over, for the file reader; None if there are none."""
        import pyarrow.dataset as ds

        def one(f: api.Filter):
            if isinstance(f, api.Not):
                return ~one(f.child)
            column = ds.field(f.attribute[0])
            if isinstance(f, api.IsNull):
                return column.is_null()
            if isinstance(f, api.IsNotNull):
                return column.is_valid()
            # a comparison with null is neither true nor false, so its negation drops the row too
            return column.is_valid() & _COMPARE[type(f)](column, f.value) if isinstance(f, api.In) else _COMPARE[type(f)](column, f.value)

        out = None
        for f in self.taken:
            e = one(f)
            if isinstance(f, api.Not) and isinstance(f.child, api.In):
                e = e & ds.field(f.child.attribute[0]).is_valid()
            out = e if out is None else out & e
        return out

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f.path) for f in _dataset(self.root, self.table).get_fragments()]

    def read(self, partition: FilePartition) -> Iterator:
        fragments = (f for f in _dataset(self.root, self.table).get_fragments() if f.path == partition.path)
        for fragment in fragments:
            for batch in fragment.to_batches(columns=self.schema.names, filter=self.expression()):
                if batch.num_rows:
                    yield batch


class FilesSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _option(self, key: str) -> str:
        value = self.options.get(key)
        if not value:
            raise ValueError(f"format {FORMAT} needs the option {key!r}")
        return value

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = from_arrow_schema(_dataset(self._option("root"), self._option("table")).schema)
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in wanted]) if wanted else whole

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(schema, self._option("root"), self._option("table"))


def register(spark: SparkSession) -> None:
    """Make the format known to the session. The source travels with the plan, so
    workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    set_unset(spark, {"spark.sql.python.filterPushdown.enabled": "true"})
    spark.dataSource.register(FilesSource)


__all__ = ["FORMAT", "FilesReader", "FilesSource", "register"]
