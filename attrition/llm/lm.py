"""Operator 9: language-model scores by deleted interpolation.

p(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1), where the weights
depend on the frequency bucket (powers of two) of the context v. They are
learned by expectation-maximisation on held-out counts: a tenth of the training
documents is deleted, its tokens are described by the estimates that the other
documents give, and the weights that make them most likely are kept. The scores
then use the counts of all training documents.

Counting and lookup are one shuffle of packed arrays instead of a row a token:

1. A map task cuts its input into slices of whole documents, writes each slice's
   tokens to one file of the shared folder, and sends the sorted hashes of the
   slice's distinct words and word pairs with their counts, one packed row for
   each range of the hash space.
2. The task of a range merges all slices' rows, adds up the counts, and answers
   every slice with the totals of its keys, in the same order.
3. The answers of a slice meet in one task, which reads the slice's file and
   computes the held-out table or the scores.

A very frequent word is one key a slice, so no task gets more than a slice's or
a range's share; what is gathered grows with the text. File names come from the
partition and the slice's number, and the content from its rows, so a repeated
task writes the same file again.

The held-out table has a row for each (bucket, pair estimate, word estimate)
with estimates rounded to quarter powers of two; its size is bounded by those
grids and it is the only thing that the driver reads besides four totals.

Defined results: null and empty text is the end token alone. A null id is a
training row. Where nothing can be learned, only the uniform part counts, and
where no document is held out the weights are fixed defaults. Repeated rows are
counted and scored each. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, map_arrow, materialize, mix64, open_fs, shared_folder, size_of_table, split_words, table, text_buffer

SLICE_BYTES = 16 << 20
RANGE_BYTES = 128 << 20
BATCH_BYTES = 1 << 20
GRID = 4  # estimates are rounded to 1/4 of a power of two
MAX_BUCKET = 48
KEPT, DELETED, HELD_OUT = 0, 1, 2
_ONE = np.uint64(1)
_START = np.uint64(0x5851F42D4C957F2C)  # context of a text's first token
_END = np.uint64(0x14057B7EF767814F)  # the end token


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (small numbers become zeros)."""
    head = f"{a.dtype.str} {len(a)}\n".encode()
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    at = data.index(b"\n")
    kind, n = data[:at].decode().split()
    dtype = np.dtype(kind)
    raw = zstandard.ZstdDecompressor().decompress(data[at + 1 :], max_output_size=int(n) * dtype.itemsize) if int(n) else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, int(n)).T).view(dtype)[:, 0] if int(n) else np.zeros(0, dtype)


def word_keys(h: np.ndarray) -> np.ndarray:
    return h | _ONE


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + word) & ~_ONE


@dataclass
class Slice:
    """Tokens of consecutive documents, each ended by the end token."""

    ids: pa.Array
    role: np.ndarray  # of each document
    length: np.ndarray  # tokens of each document
    vocabulary: np.ndarray  # distinct word keys, sorted
    token: np.ndarray  # index into the vocabulary

    @classmethod
    def from_texts(cls, ids: pa.Array, role: np.ndarray, hashes: list[np.ndarray], lengths: list[np.ndarray]) -> Slice:
        n = np.concatenate(lengths)
        tokens = np.insert(word_keys(np.concatenate(hashes)), np.cumsum(n), word_keys(_END))
        vocabulary, token = np.unique(tokens, return_inverse=True)
        return cls(ids, role, n + 1, vocabulary, token.astype(np.uint32))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair keys with the start context, and each token's pair."""
        words = self.vocabulary[self.token]
        context = np.empty_like(words)
        context[1:] = words[:-1]
        context[np.cumsum(self.length) - self.length] = _START & ~_ONE
        return np.unique(pair_keys(context, words), return_inverse=True)

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        start = np.array([_START & ~_ONE])
        return np.sort(np.concatenate([self.vocabulary, pairs, start]))

    def counts(self, keys: np.ndarray, pairs: np.ndarray, pair: np.ndarray, role: int) -> np.ndarray:
        """How often each key occurs in the slice's documents of one role."""
        on = np.repeat(self.role == role, self.length)
        out = np.zeros(len(keys), np.uint32)
        out[np.searchsorted(keys, self.vocabulary)] = np.bincount(self.token[on], minlength=len(self.vocabulary))
        out[np.searchsorted(keys, pairs)] = np.bincount(pair[on], minlength=len(pairs))
        out[np.searchsorted(keys, _START & ~_ONE)] = (self.role == role).sum()
        return out

    def write(self, uri: str) -> None:
        fs, path = open_fs(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids)]
        columns += [pa.array([pack(a)], pa.large_binary()) for a in (self.role, self.length, np.diff(self.vocabulary, prepend=np.uint64(0)), self.token)]
        batch = pa.RecordBatch.from_arrays(columns, names=["ids", "role", "length", "vocabulary", "token"])
        temporary = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out, pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        fs.move(temporary, path)

    @classmethod
    def read(cls, uri: str) -> Slice:
        fs, path = open_fs(uri)
        with fs.open_input_stream(path) as source:
            b = pa.ipc.open_stream(source).read_next_batch()
        role, length, vocabulary, token = (unpack(b.column(i)[0].as_py()) for i in range(1, 5))
        return cls(b.column(0).flatten(), role, length, np.cumsum(vocabulary, dtype=np.uint64), token)


@dataclass
class Totals:
    """Tokens and distinct words of all training documents and of the kept ones."""

    tokens: int = 0
    words: int = 0
    kept_tokens: int = 0
    kept_words: int = 0


class Estimates:
    """Counts behind each token of a slice, from the answers to its keys."""

    def __init__(self, piece: Slice, counts: np.ndarray, pairs: np.ndarray, pair: np.ndarray):
        keys = piece.keys(pairs)
        of_word = counts[np.searchsorted(keys, piece.vocabulary)][piece.token].astype(np.int64)
        self.word = of_word
        self.pair = counts[np.searchsorted(keys, pairs)][pair].astype(np.int64)
        self.context = np.empty_like(of_word)
        self.context[1:] = of_word[:-1]
        self.context[np.cumsum(piece.length) - piece.length] = counts[np.searchsorted(keys, _START & ~_ONE)]

    def parts(self, tokens: int, words: int) -> tuple[np.ndarray, np.ndarray, float]:
        return self.pair / np.maximum(self.context, 1), self.word / max(tokens, 1), 1.0 / (words + 1)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than its count's power of two."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), MAX_BUCKET).astype(np.int64)


def learn_weights(cells: list[tuple[int, float, float, int]], uniform: float, trained: bool, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation.

    ``cells``: (bucket, pair estimate, word estimate, number of held-out tokens).
    One token's worth of the default weights is added to each bucket, which keeps
    all weights above zero; buckets without held-out tokens keep the defaults."""
    weights = np.tile([0.5, 0.4, 0.1], (MAX_BUCKET + 1, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not trained:
        weights[:] = [0.0, 0.0, 1.0]
        return weights
    prior = weights.copy()
    if not cells:
        return weights
    b = np.array([c[0] for c in cells])
    p = np.array([[c[1], c[2], uniform] for c in cells])
    n = np.array([c[3] for c in cells], float)
    for _ in range(rounds):
        mixed = weights[b] * p
        mixed *= (n / mixed.sum(axis=1))[:, None]
        total = prior.copy()
        np.add.at(total, b, mixed)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


@dataclass
class Model:
    """Answers for every slice, the totals, and the learned weights."""

    answers: DataFrame
    totals: Totals
    weights: np.ndarray
    parts: int
    id_type: str


def train(
    docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES
) -> Model:
    """Count all of ``docs`` (``role``: 0 kept, 1 deleted, 2 held out) and learn the weights."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (max(parts, size_of_table(docs) // range_bytes) - 1).bit_length())
    folder = shared_folder(spark, "lm-slices")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.cast("int").alias("role"))

    def requests(piece: Slice, uri: str) -> pa.RecordBatch:
        pairs, pair = piece.pairs()
        keys = piece.keys(pairs)
        kept, deleted = (piece.counts(keys, pairs, pair, r) for r in (KEPT, DELETED))
        piece.write(uri)
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        bounds = [0, *cuts.tolist(), len(keys)]
        rows = [
            (r, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(kept[a:b]), pack(deleted[a:b]))
            for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            if b > a
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int32()), pa.array([uri] * len(rows)), *(pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3))],
            names=["range", "slice", "keys", "kept", "deleted"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = number = 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            piece = Slice.from_texts(ids, np.concatenate([x[1] for x in held]), [x[2] for x in held], [x[3] for x in held])
            return requests(piece, f"{folder}/{part:07d}-{number:05d}")

        for b in by_bytes(batches, "text", BATCH_BYTES):
            data, off = text_buffer(b.column(1))
            words = split_words(data, off, lower=True)
            held.append((b.column(0), b.column(2).to_numpy().astype(np.uint8), words.hash, np.diff(words.first)))
            size += len(data)
            if size >= slice_bytes:
                yield flush()
                held, size, number = [], 0, number + 1
        if held:
            yield flush()

    asked = map_arrow(picked, count, "range int, slice string, keys binary, kept binary, deleted binary")

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in group["keys"].to_pylist()]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        kept, deleted = (
            np.bincount(of, weights=np.concatenate([unpack(x) for x in group[c].to_pylist()]), minlength=len(distinct)).astype(np.int64) for c in ("kept", "deleted")
        )
        is_word = (distinct & _ONE).astype(bool)
        every = kept + deleted
        bounds = np.cumsum([0, *map(len, keys)])
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        rows = len(spans)
        one = lambda x: pa.array([int(x)] + [0] * (rows - 1), pa.int64())  # noqa: E731  a range's totals stand in its first row
        return pa.table(
            {
                "range": group["range"],
                "slice": group["slice"],
                "every": pa.array([pack(every[of[a:b]].astype(np.uint32) if every.max(initial=0) < 1 << 32 else every[of[a:b]]) for a, b in spans], pa.binary()),
                "kept": pa.array([pack(kept[of[a:b]].astype(np.uint32) if kept.max(initial=0) < 1 << 32 else kept[of[a:b]]) for a, b in spans], pa.binary()),
                "tokens": one(every[is_word].sum()),
                "words": one((every[is_word] > 0).sum()),
                "kept_tokens": one(kept[is_word].sum()),
                "kept_words": one((kept[is_word] > 0).sum()),
            }
        )

    answers = asked.groupBy("range").applyInArrow(
        answer, "range int, slice string, every binary, kept binary, tokens long, words long, kept_tokens long, kept_words long"
    )
    answers = materialize(answers, "lm-answers")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "kept_tokens", "kept_words")]).first()
    totals = Totals(*map(int, sums))

    def held_out_table(group: pa.Table) -> pa.Table:
        piece = Slice.read(group["slice"][0].as_py())
        on = np.repeat(piece.role == DELETED, piece.length)
        none = pa.table({"bucket": pa.array([], pa.int32()), "pair": pa.array([], pa.int32()), "word": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        if not on.any():
            return none
        pairs, pair = piece.pairs()
        e = Estimates(piece, in_order(group, "kept"), pairs, pair)
        p2, p1, _ = e.parts(totals.kept_tokens, totals.kept_words)
        cells = np.stack([bucket_of(e.context[on]), grid(p2[on]), grid(p1[on])])
        distinct, n = np.unique(cells, axis=1, return_counts=True)
        return pa.table({"bucket": pa.array(distinct[0], pa.int32()), "pair": pa.array(distinct[1], pa.int32()), "word": pa.array(distinct[2], pa.int32()), "n": pa.array(n, pa.int64())})

    cells = answers.select("range", "slice", "kept").repartition(parts, "slice").groupBy("slice").applyInArrow(held_out_table, "bucket int, pair int, word int, n long")
    cells = cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).orderBy("bucket", "pair", "word").collect()
    found = [(c.bucket, ungrid(c.pair), ungrid(c.word), c.n) for c in cells]
    weights = learn_weights(found, 1.0 / (totals.kept_words + 1), totals.tokens > 0)
    return Model(answers, totals, weights, parts, picked.schema["id"].dataType.simpleString())


def in_order(group: pa.Table, column: str) -> np.ndarray:
    """The answers to a slice's keys, in the order of the keys."""
    order = np.argsort(group["range"].to_numpy())
    cells = group[column].to_pylist()
    return np.concatenate([unpack(cells[i]) for i in order.tolist()])


def grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 2.0**-48)) * GRID), 1).astype(np.int64)


def ungrid(k: int) -> float:
    return 0.0 if k > 0 else 2.0 ** (k / GRID)


def score(model: Model) -> DataFrame:
    """(id, role, n_tokens, n_known, base_score, score) of every document of the training call."""
    totals, weights, parts = model.totals, model.weights, model.parts

    def run(group: pa.Table) -> pa.Table:
        piece = Slice.read(group["slice"][0].as_py())
        pairs, pair = piece.pairs()
        e = Estimates(piece, in_order(group, "every"), pairs, pair)
        p2, p1, p0 = e.parts(totals.tokens, totals.words)
        w = weights[bucket_of(e.context)]
        logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((e.word + 1) / (totals.tokens + 1.0 * (totals.words + 1)))
        at = np.cumsum(piece.length) - piece.length
        return pa.table(
            {
                "id": piece.ids,
                "role": pa.array(piece.role, pa.int32()),
                "n_tokens": pa.array(piece.length, pa.int64()),
                "n_known": pa.array(np.add.reduceat((e.word > 0).astype(np.int64), at), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(logs, at)),
            }
        )

    asked = model.answers.select("range", "slice", "every").repartition(parts, "slice")
    return asked.groupBy("slice").applyInArrow(run, f"id {model.id_type}, role int, n_tokens long, n_known long, base_score double, score double")


def split_role(doc_id: str = "doc_id") -> Column:
    """2 where crc32 of the id as text leaves 2 by division by 7; of the others a
    tenth (by the next digits of the checksum) is deleted for the weights."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    inside = F.when(F.floor(crc / 7) % 10 == 0, F.lit(DELETED)).otherwise(F.lit(KEPT))
    return F.when(F.coalesce(crc % 7 == 2, F.lit(False)), F.lit(HELD_OUT)).otherwise(inside)


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"), split_role())
    return score(model).select(
        F.col("id").alias("doc_id"),
        (F.col("role") == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.totals.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op9_deleted_interpolation": op9_deleted_interpolation}
