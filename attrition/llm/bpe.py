"""Operator 1: byte-level BPE encoding and decoding.

Encoding: the text is cut by the tokenizer's pattern; every match is merged on
its own. Distinct unseen matches of a batch are grouped by length into padded
integer matrices, one row a match. Each round looks up the rank of all adjacent
pairs in a bucketed hash table, every row merges its leftmost pair of minimum
rank, and the matrix is compacted by one column; rows without a mergeable pair
leave. Matches longer than ``LONG`` symbols take the same merge rule with a
heap, so that one very long run costs n log n.

The pattern never joins the two sides of a blank that stands before a visible
ASCII character or a letter of U+00C0-U+07FF, so texts are first cut there and
each distinct piece is tokenised once per worker (a bounded cache: when it is
full it is emptied, results do not change).

Decoding gathers the bytes of the ids. Both directions run in a map over the
scan; nothing is shuffled. The rank table is read once on the driver and sent
with the task (its size is that of the vocabulary file).

Null text encodes as empty; an empty text has no ids and decodes to no bytes.
Repeated rows are encoded each; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, expand, map_arrow, table

LONG = 512
CACHE_PIECES = 300_000
BATCH_BYTES = 4 << 20
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 token, blank, id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Bucketed hash table (left id, right id) -> id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None:
                    b = ranks.get(token[cut:])
                    if b is not None:
                        keys.append((a << 32) | b)
                        vals.append(rank)
        keys_a = np.array(keys, np.uint64)
        vals_a = np.array(vals, np.int32)
        self.bits = max(4, int(len(keys_a)).bit_length() + 2)
        bucket = self._bucket(keys_a)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        slot = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        self.width = int(slot.max()) + 1 if len(slot) else 1
        self.keys = np.full((self.width, 1 << self.bits), np.uint64(2**64 - 1))
        self.vals = np.full((self.width, 1 << self.bits), _NONE)
        self.keys[slot, bucket] = keys_a[order]
        self.vals[slot, bucket] = vals_a[order]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int32 where the pair cannot merge.
        Ids below zero (padding) never match."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        bucket = self._bucket(keys)
        out = np.where(self.keys[0][bucket] == keys, self.vals[0][bucket], _NONE)
        for w in range(1, self.width):
            hit = self.keys[w][bucket] == keys
            if hit.any():
                out = np.where(hit, self.vals[w][bucket], out)
        return out


class BytePairCodec:
    """Encodes and decodes with a rank file; made from plain parts so that it
    can be shipped to workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_len = lengths
        self.token_start = np.cumsum(lengths) - lengths
        blob = np.zeros(int(lengths.sum()), np.uint8)
        for token, rank in ranks.items():
            at = self.token_start[rank]
            blob[at : at + len(token)] = np.frombuffer(token, np.uint8)
        self.token_bytes = blob
        self.cache = PieceCache(self.encode_pieces)

    # -- merging -----------------------------------------------------------

    def _merge_matrix(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge every row of ``ids`` (-1 pads the right) to the end; finished
        rows go to ``out`` as (row numbers, number of ids, ids)."""

        def finish(rows: np.ndarray, ids: np.ndarray) -> None:
            real = ids >= 0
            out.append((rows, real.sum(axis=1), ids[real]))

        ranks = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1] == 0:
                return finish(rows, ids)
            at = ranks.argmin(axis=1)  # the first of equal minima: the leftmost
            here = np.arange(len(rows))
            best = ranks[here, at]
            done = best == _NONE
            if done.any():
                finish(rows[done], ids[done])
                live = ~done
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
                here = here[: len(rows)]
                if not len(rows):
                    return None
            n, width = ids.shape
            ids[here, at] = best  # a token's id is its rank
            keep = np.ones((n, width), bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[here, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                left = np.flatnonzero(at > 0)
                if len(left):
                    p = at[left]
                    ranks[left, p - 1] = self.pairs.lookup(ids[left, p - 1], ids[left, p])
                right = np.flatnonzero(at < width - 2)
                if len(right):
                    p = at[right]
                    ranks[right, p] = self.pairs.lookup(ids[right, p], ids[right, p + 1])

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        """The same rule over a linked list and a heap, for very long matches."""
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        one = np.array(ids, np.int32)
        first = self.pairs.lookup(one[:-1], one[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        ranks, parts = self.ranks, [None] * n
        token = lambda i: parts[i] if parts[i] is not None else self._bytes_of(ids[i])
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            parts[i] = token(i) + token(j)
            ids[i], ids[j] = rank, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                r = ranks.get(token(i) + token(nxt[i]))
                if r is not None:
                    heapq.heappush(heap, (r, i, rank, ids[nxt[i]]))
            if prv[i] >= 0:
                r = ranks.get(token(prv[i]) + token(i))
                if r is not None:
                    heapq.heappush(heap, (r, prv[i], ids[prv[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _bytes_of(self, i: int) -> bytes:
        at = self.token_start[i]
        return self.token_bytes[at : at + self.token_len[i]].tobytes()

    def merge_all(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each match merged on its own: (ids, start in them, number of ids)."""
        out: list = []
        lengths = np.fromiter(map(len, matches), np.int64, len(matches))
        for i in np.flatnonzero(lengths > LONG).tolist():
            ids = self._merge_long(self.byte_id[np.frombuffer(matches[i], np.uint8)].tolist())
            out.append((np.array([i]), np.array([len(ids)]), ids))
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, LONG):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(rows, len(rows) * high // 1_000_000 + 1):
                if not len(part):
                    continue
                flat = np.frombuffer(b"".join([matches[i] for i in part.tolist()]), np.uint8)
                ids = np.full((len(part), high), np.int32(-1))
                ids[np.arange(high) < lengths[part][:, None]] = self.byte_id[flat]
                self._merge_matrix(ids, part, out)
        n_ids = np.zeros(len(matches), np.int64)
        start = np.zeros(len(matches), np.int64)
        base = 0
        for rows, n, ids in out:
            n_ids[rows] = n
            start[rows] = base + np.cumsum(n) - n
            base += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *[ids for _, _, ids in out]]), start, n_ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        matches, counts = [], np.ones(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            text = piece.decode("utf-8", "surrogateescape")
            if text[text[:1] == " " :].isalpha():  # letters only, perhaps after one blank: one match
                matches.append(text)
            else:
                found = self.find(text)
                counts[i] = len(found)
                matches += found
        index = dict.fromkeys(matches)
        distinct = [m.encode("utf-8", "surrogateescape") for m in index]
        index = dict(zip(index, range(len(index)), strict=True))
        of = np.fromiter(map(index.__getitem__, matches), np.int64, len(matches))
        whole = np.array([-1 if r is None else r for r in map(self.ranks.get, distinct)], np.int64)
        rest = np.flatnonzero(whole < 0)
        merged, at, n = self.merge_all([distinct[i] for i in rest.tolist()])
        start = np.empty(len(distinct), np.int64)
        n_ids = np.ones(len(distinct), np.int64)
        ready = whole >= 0
        start[ready] = len(merged) + np.arange(int(ready.sum()))
        start[rest], n_ids[rest] = at, n
        flat = np.concatenate([merged, whole[ready].astype(np.int32)])
        per_match = n_ids[of]
        bounds = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(per_match)])
        return flat[expand(start[of], per_match)], total[bounds] - total[bounds - counts]

    # -- whole texts -------------------------------------------------------

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as int32, offsets of each text)."""
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[expand(self.token_start[ids], self.token_len[ids])]


class PieceCache:
    """Cuts texts where no match can cross, and tokenises each distinct piece once."""

    def __init__(self, encode_pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_PIECES):
        import re

        self.encode_pieces = encode_pieces
        self.limit = limit
        self.odd = re.compile(rb" (?![!-~\xc3-\xdf])").search
        self.cut = re.compile(rb" (?=[!-~\xc3-\xdf])").split
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.head: dict[bytes, int] = {}  # a text's first piece has no leading blank
        self.count = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)

    def _add(self, seen: dict[bytes, int], pieces: list[bytes], lead: bytes) -> None:
        ids, n = self.encode_pieces([lead + p for p in pieces] if lead else pieces)
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, 2 * len(self.flat)) - len(self.flat), np.int32)])
        self.flat[self.used : need] = ids
        first, last = self.count, self.count + len(pieces)
        if last > len(self.start):
            grow = np.zeros(max(last, 2 * len(self.start)) - len(self.start), np.int64)
            self.start, self.length = np.concatenate([self.start, grow]), np.concatenate([self.length, grow])
        self.start[first:last] = self.used + np.cumsum(n) - n
        self.length[first:last] = n
        seen.update(zip(pieces, range(first, last), strict=True))
        self.used, self.count = need, last

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.count > self.limit:
            self.clear()
        heads, tails, counts = [], [], []
        for t in texts:
            parts = (self.cut(t) if self.odd(t) else t.split(b" ")) if t else []
            if parts:
                heads.append(parts[0])
                tails += parts[1:]
            counts.append(len(parts))
        for seen, pieces, lead in ((self.head, heads, b""), (self.index, tails, b" ")):
            new = set(pieces).difference(seen)
            if new:
                self._add(seen, list(new), lead)
        n = np.array(counts, np.int64)
        some = n > 0
        ends = np.cumsum(n)
        at = np.empty(int(n.sum()), np.int64)
        is_head = np.zeros(len(at), bool)
        is_head[(ends - n)[some]] = True
        at[is_head] = np.fromiter(map(self.head.__getitem__, heads), np.int64, len(heads))
        at[~is_head] = np.fromiter(map(self.index.__getitem__, tails), np.int64, len(tails))
        lengths = self.length[at]
        ids = self.flat[expand(self.start[at], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.concatenate([[0], total[ends]])


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def vocabulary_digest(ranks: dict[bytes, int]) -> str:
    """SHA-256 of all tokens and ranks, in order of rank."""
    told = hashlib.sha256()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        told.update(b"%d %d " % (rank, len(token)) + token)
    return told.hexdigest()


def worker_codec(ranks: dict[bytes, int], pattern: str | None) -> BytePairCodec:
    """One codec per worker process, vocabulary and pattern; without a pattern (to
    decode) any codec of the vocabulary."""
    digest = vocabulary_digest(ranks)
    if pattern is None:
        pattern = next((p for d, p in _CODECS if d == digest), "")
    if (digest, pattern) not in _CODECS:
        _CODECS[digest, pattern] = BytePairCodec(ranks, pattern)
    return _CODECS[digest, pattern]


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with ``ids`` (array of int) of every whole text.

    Other columns of ``docs`` are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(ranks.value, pattern)
        for b in by_bytes(batches, "text", BATCH_BYTES):
            ids, off = codec.encode(text_bytes(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` with ``payload``: the bytes that the ids stand for (null ids: no bytes)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(ranks.value, None)
        for b in batches:
            rows = [codec.decode(np.array(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "payload"])

    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {kind}, payload binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids (little-endian uint32) and
    of the bytes they decode to; ``with_ids`` adds the ids themselves."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(ranks.value, pattern)
        for b in by_bytes(batches, "text", BATCH_BYTES):
            ids, off = codec.encode(text_bytes(b.column(1)))
            words = ids.astype("<u4")
            data = codec.decode(ids)
            at = np.concatenate([[0], np.cumsum(codec.token_len[ids])])[off]
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            bytes_at = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            columns = [
                b.column(0),
                pa.array(np.diff(off), pa.int64()),
                pa.array([hashlib.sha256(words[x:y]).hexdigest() for x, y in spans], pa.string()),
                pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in bytes_at], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_arrow(picked, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), *default_vocabulary())


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
