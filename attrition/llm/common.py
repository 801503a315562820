"""Shared helpers of the training-data operators.

Text handling inside tasks works on whole Arrow buffers with numpy: a batch of
documents is one byte array plus document offsets, a word is a maximal run of
bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a
character, so byte-level splitting equals splitting the text.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import attrition
from attrition.session import checkpoint_root, scratch_path, set_unset

#: The white-space bytes of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Rows of a record batch between Spark and its Python workers.
ARROW_ROWS = 1000

#: Bytes of text that are split into words at a time.
PIECE_BYTES = 4 << 20

# Freed Arrow memory goes back to the system instead of staying with the worker.
pa.set_memory_pool(pa.system_memory_pool())

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False
_IS_PLAIN = _IS_WORD.copy()
_IS_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False  # ASCII punctuation
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]  # A-Z hash like a-z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage with files every executor can read; the folder is removed
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared scratch space, as a URI that workers can open."""
    path = scratch_path(spark, name)
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    delete_on_exit(spark, path)
    return path


def open_fs(uri: str):
    """(filesystem, path) of a URI in the shared folder: local, HDFS or object store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once an application: they may neither have it
    installed nor share the driver's folder. Nothing to do when the driver itself
    has it from a shipped archive."""
    sc = spark.sparkContext
    home = Path(attrition.__file__).parent
    if sc.applicationId in _SHIPPED or not home.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="attrition-py-")) / "attrition.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in record batches of at most ``ARROW_ROWS`` rows (unless the
    session sets another number): texts are long, and a batch is held in memory on
    both sides."""
    ship_package(df.sparkSession)
    set_unset(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)})
    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def size_of_table(df: DataFrame) -> int:
    """Bytes of the files behind a scan, as the optimizer knows them (no job);
    0 where it knows nothing (it then assumes the largest possible size)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U64)
        self.down = np.ones(1, _U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U64(pow(_BASE_INV, m, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of a batch: byte ranges, 64-bit hashes, and first word of each document."""

    data: np.ndarray  # uint8, the batch's text bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64
    first: np.ndarray  # n_docs + 1: index of each document's first word


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    if bufs[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cut documents in one buffer into runs of about ``limit`` bytes: (first document,
    last document + 1, their offsets within the run). A document over the limit is cut
    at white space, where no word crosses; a word over the limit stays whole."""
    i, docs = 0, len(offsets) - 1
    at = int(offsets[0])
    while i < docs:
        j = int(np.searchsorted(offsets, at + limit, side="right")) - 1
        if j > i:
            yield i, j, np.concatenate([[at], offsets[i + 1 : j + 1]])
            i, at = j, int(offsets[j])
            continue
        end, cut = int(offsets[i + 1]), at + limit
        while cut < end:
            blank = np.flatnonzero(~_IS_WORD[data[cut : min(cut + (1 << 16), end)]])
            if len(blank):
                cut += int(blank[0])
                break
            cut += 1 << 16
        cut = min(cut, end)
        yield i, i + 1, np.array([at, cut])
        at = cut
        if cut == end:
            i += 1


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of the characters of scripts that are written without spaces: Thai,
    Lao, Myanmar, Khmer, kana, CJK ideographs and their punctuation, full and half
    width forms (three bytes each), and ideographs of four bytes."""
    at = np.flatnonzero(data[:-2] >= 0xE0) if len(data) > 2 else np.zeros(0, np.int64)
    a, b = data[at], data[at + 1]
    pick = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F)))
    pick |= ((a == 0xE3) & (b != 0x84) & (b != 0x85)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | (b == 0xBC) | (b == 0xBD) | (b == 0xBE)))
    pick |= (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    return at[pick]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False, inside: np.ndarray | None = None) -> Words:
    """Words of consecutive documents with their hashes (``lower``: A-Z as a-z;
    ``plain``: ASCII punctuation parts words as white space does, and each character
    of a script without spaces is a word; ``inside``: flags of the bytes of a word,
    where white space never is one).

    More than ``PIECE_BYTES`` are split piece by piece: some 60 bytes a byte of one piece
    are held, and 24 bytes a word of the whole."""
    if len(data) <= PIECE_BYTES:
        return _split(data, offsets, lower, plain, inside)
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last, cuts in pieces(data, offsets, PIECE_BYTES):
        part = _split(data[cuts[0] : cuts[-1]], cuts - cuts[0], lower, plain, inside)
        found.append((part.start + cuts[0], part.end + cuts[0], part.hash))
        counts[first:last] += np.diff(part.first)
    start, end, hashes = (np.concatenate([x[i] for x in found]) for i in range(3))
    return Words(data, start, end, hashes, np.concatenate([[0], np.cumsum(counts)]))


def _split(data: np.ndarray, offsets: np.ndarray, lower: bool, plain: bool, inside: np.ndarray | None) -> Words:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, _U64), np.zeros(len(offsets), np.int64))
    if inside is None:
        inside = _IS_PLAIN if plain else _IS_WORD
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word
    ends[:-1] &= ~inside[data[1:]] | edge[1:n]
    single = unspaced(data) if plain else np.zeros(0, np.int64)
    if len(single):
        after = single + np.where(data[single] == 0xF0, 4, 3)
        starts[single] = ends[after - 1] = True
        before = single[single > 0] - 1
        ends[before] |= inside[data[before]]
        after = after[after < n]
        starts[after] |= inside[data[after]]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    # exponents count from each document's start, so the tables stay as long as the longest one
    sizes = np.diff(offsets)
    up, down = _POWERS.upto(int(sizes.max(initial=0)))
    place = np.arange(n, dtype=np.int64) - np.repeat(offsets[:-1], sizes)
    total = np.zeros(n + 1, _U64)
    np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[data] * up[place], out=total[1:])
    h = mix64((total[e] - total[s]) * down[place[s]] + (e - s).astype(_U64))
    return Words(data, s, e, h, np.searchsorted(s, offsets))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (runs may cross documents)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, _U64)
    out = np.zeros(m, _U64)
    for j in range(k):
        out *= _U64(_BASE)
        out += h[j : j + m]
    return mix64(out)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each
    (a single longer value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i)
            i = j


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start + length`` as one index array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - lead, lengths)
