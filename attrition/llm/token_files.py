"""Operator 5: token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id, so that files follow each
other in ascending id order. Each task encodes its documents, appends the end
id, and writes its token stream as one Arrow IPC file whose record batches have
two fixed-size-list columns: ``ids`` (uint16 when the vocabulary allows, else
uint32) and ``mask`` (true for a token, false for the padding that fills the
last sequence). Equal widths make the byte position of any token a constant
multiple, so a reader maps the file and slices without parsing or copying.

Files are named by attempt; only names that a finished task returned are in the
index, so the leftovers of a lost executor are never read. The index (one row a
document: file, position in it, length) is a table in the same shared folder,
and a small table of file totals turns positions into global offsets.

Ids are those of the tokenizers library. A text is first cut at blanks that the
byte-level pattern always cuts at (see ``bpe.PieceCache``), and the library
encodes each distinct piece once per worker. Texts that hold an added token of
the JSON (``<|endoftext|>``) are handed to the library whole, as such a token also
ends the match before it. ``special_tokens`` gives the library's default, ids of
the special tokens for their strings; without it they are ordinary text.

Null text counts as empty (only the end id). Documents of one id follow each
other by text hash; null ids come first. An empty table gives no files and an
empty result. Only the id and text columns are read, so other columns may have
any name.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.llm.bpe import PieceCache, text_bytes
from attrition.llm.common import by_bytes, map_arrow, materialize, open_fs, shared_folder, size_of_table, table

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
BATCH_BYTES = 4 << 20
FILE_BYTES = 128 << 20
CACHE_PIECES = 1_000_000

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
_TOKENIZERS: dict[str, tuple[int, Encode]] = {}


def worker_tokenizer(text: str, special_tokens: bool = False) -> tuple[int, Encode]:
    """(vocabulary size, encoder of texts) of a tokenizer's JSON, once per worker process."""
    key = f"{len(text)}-{zlib.crc32(text.encode())}-{special_tokens}"
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(text)
        tok.encode_special_tokens = not special_tokens  # if set, their strings in a text are ordinary text
        added = [t["content"].encode() for t in json.loads(text).get("added_tokens") or () if special_tokens or not t["special"]]
        holds_added = re.compile(b"|".join(map(re.escape, added))).search if added else None

        def pieces(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            words = [p.decode("utf-8", "replace") for p in parts]
            e = tok.encode(words, is_pretokenized=True, add_special_tokens=False)
            return np.array(e.ids, np.int32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(parts))

        cache = PieceCache(pieces, CACHE_PIECES)

        def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            whole = [i for i, t in enumerate(texts) if holds_added and holds_added(t)]
            if not whole:
                return cache.encode(texts)
            rest = list(texts)
            for i in whole:
                rest[i] = b""
            ids, off = cache.encode(rest)
            parts = np.split(ids, off[1:-1])
            for i in whole:
                parts[i] = np.array(tok.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, ids.dtype)
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

        _TOKENIZERS[key] = tok.get_vocab_size(), encode
    return _TOKENIZERS[key]


class SequenceWriter:
    """Streams ids into fixed-length sequences of one Arrow file."""

    def __init__(self, uri: str, width: int, vocabulary: int):
        fs, path = open_fs(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.width = width
        kind = pa.list_(pa.from_numpy_dtype(self.dtype), width)
        self.schema = pa.schema([("ids", kind), ("mask", pa.list_(pa.bool_(), width))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.width * SEQUENCES_PER_BATCH:
            self._flush(SEQUENCES_PER_BATCH)

    def _flush(self, step: int) -> None:
        flat = np.concatenate(self.waiting)
        size = step * self.width
        whole = len(flat) // size * size
        for i in range(0, whole, size):
            self._batch(flat[i : i + size], size)
        self.waiting = [flat[whole:]]
        self.held = len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.writer.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.width), pa.FixedSizeListArray.from_arrays(mask, self.width)],
                schema=self.schema,
            )
        )

    def close(self) -> None:
        flat = np.concatenate([*self.waiting, np.zeros(0, self.dtype)])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.width) * self.width, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to the tokens of one file; local files are memory-mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs as pafs

        fs, path = open_fs(uri)
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.width = self.reader.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}

    def batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.reader.get_batch(k)}
        return self.batches[k]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``k``; the ids are a view of the mapped file."""
        b = self.batch(k // SEQUENCES_PER_BATCH)
        at = (k % SEQUENCES_PER_BATCH) * self.width
        mask = b.column(1).flatten().slice(at, self.width).to_numpy(zero_copy_only=False)
        return b.column(0).flatten().to_numpy()[at : at + self.width], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        size = self.width * SEQUENCES_PER_BATCH
        parts = []
        while n > 0:
            k, at = divmod(start, size)
            part = self.batch(k).column(0).flatten().to_numpy()[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])

    def close(self) -> None:
        self.batches = {}
        self.file.close()


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 0,
    width: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_tokens: bool = False,
) -> DataFrame:
    """Write the files below ``folder``; returns the index
    (``id, part, file, at, n``: position and number of ids in the file)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of_table(docs) // FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, encode = worker_tokenizer(vocabulary.value, special_tokens)
        part = TaskContext.get().partitionId()
        uri = f"{folder}/{part:07d}-{uuid.uuid4().hex}.arrow"
        writer = None
        for b in by_bytes(batches, "text", BATCH_BYTES):
            if writer is None:
                writer = SequenceWriter(uri, width, max(size, end_id + 1))
            ids, off = encode(text_bytes(b.column(1)))
            n = np.diff(off) + 1
            at = writer.total + np.cumsum(n) - n
            writer.add(np.insert(ids, off[1:], end_id))
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(rows, part)), pa.array([uri] * rows), pa.array(at), pa.array(n)],
                names=["id", "part", "file", "at", "n"],
            )
        if writer is not None:
            writer.close()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    ordered = picked.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text"))
    index = map_arrow(ordered, run, f"id {kind}, part long, file string, at long, n long")
    return materialize(index, "token-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Read every document back: (id, start, n, crc32 of its ids as little-endian uint32).

    ``start`` counts the ids of all documents before it, over all files."""
    totals = index.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for b in batches:
            crc = []
            for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                if file != uri:
                    if reader is not None:
                        reader.close()
                    uri, reader = file, SequenceReader(file)
                crc.append(zlib.crc32(reader.tokens(at, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("at"), b.column("n"), pa.array(crc, pa.int64())], names=["id", "part", "at", "n", "crc"])
        if reader is not None:
            reader.close()

    kind = index.schema["id"].dataType.simpleString()
    read = map_arrow(index, run, f"id {kind}, part long, at long, n long, crc long")
    return read.join(base, "part").select("id", (F.col("base") + F.col("at")).alias("start"), "n", "crc")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    index = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark, "token-files"), special_tokens=True)
    read = read_token_files(index)
    return read.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


QUERIES = {"op5_token_files": op5_token_files}
