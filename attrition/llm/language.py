"""Operator 6: language identification with language-bitmask n-gram filters.

Learning: byte n-grams of lower-cased words (with a blank at both ends) are
counted by language over all labelled rows. A language's set
holds the n-grams that make up at least ``min_share`` of its n-grams, whatever
other languages hold them too; the share bounds the set's size (at most
1 / ``min_share`` entries a language and length). Each language's set is put into a
Bloom filter. The filters are bit-sliced: slot ``i`` holds one bit for every
language, so a lookup is the AND of ``probes`` slots and returns all languages
whose set may contain the n-gram.

Prediction: the bitmasks of all n-grams of a whole text are counted by language.
With n n-grams, c hits and false-positive rate f of the language's filter, the
corrected count is (c - f n) / (1 - f), at least 0. The language of the largest
corrected count wins (ties: the smaller name). The score is that count as a share
of the text's n-grams, so it does not depend on how many languages were learned.
``learn_bound`` gives the score below which a text is in none of them, from
labelled rows.

Texts over ``PIECE_BYTES`` are counted piece by piece, cut at blanks, where no n-gram
crosses; a task holds some 100 bytes a byte of a piece, and the text itself.

The slots take 8 bytes for each 64 languages; above ``WIDE`` languages there are fewer
slots, so that all take at most 128 MB, at a higher (and corrected) false rate.

Counts and bound come from every labelled row. A task adds up its counts and passes
them on in parts of at most ``HELD_GRAMS`` n-grams, so it holds no more than these.

Defined results: null text and text without a letter are ``und`` with score 0,
also where nothing could be learned. Text with letters but no known n-gram gets
the language of most training rows with score 0. Rows with null language are not
learned from. A null id is not held out. Repeated rows are predicted each; an
empty table gives an empty result. Other columns pass through ``predict`` unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, map_arrow, materialize, mix64, pieces, table, text_buffer

UNKNOWN = "und"
SIZES = (2, 3, 4)
HELD_GRAMS = 1 << 20
MIN_SHARE = 5e-5
SLOT_BITS = 20
PROBES = 2
WIDE = 1024
BATCH_BYTES = 1 << 19
PIECE_BYTES = 1 << 20
SCORE_STEPS = 1 << 16
BOUND_SHARE = 0.001  # of labelled rows lie below the level that the bound is half of

_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[33:48] = _FOLD[58:65] = _FOLD[91:97] = _FOLD[123:127] = 32  # ASCII punctuation parts words
_FOLD[48:58] = 32  # and so do digits


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the byte n-grams inside documents, runs of blanks
    left out; ``data`` is folded and every document starts and ends with a blank."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(m, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | data[j : j + m]
    blank = data == 32
    keep = ~(blank[:m] & blank[1 : m + 1])
    if n > 2:
        inner = np.zeros(m, bool)
        for j in range(1, n - 1):
            inner |= blank[j : j + m]
        keep &= ~inner
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    last = np.repeat(offsets[1:], np.diff(offsets))[:m]
    keep &= np.arange(m) + n <= last
    return mix64(code[keep] + np.uint64(n << 56)), doc[keep]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of the texts, each between two blanks."""
    return fold(*text_buffer(texts))


def fold(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(off) - 1
    out = np.full(len(data) + 2 * rows, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, np.diff(off))
    out[at] = _FOLD[data]
    return out, off + 2 * np.arange(rows + 1)


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``slots`` has a row of 64-bit words for each slot."""

    languages: list[str]
    slots: np.ndarray  # (2 ** slot_bits, words) uint64
    false_rate: np.ndarray  # of each language
    fallback: str | None

    @staticmethod
    def positions(h: np.ndarray, slot_bits: int, probes: int) -> list[np.ndarray]:
        second = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(k) * second) & np.uint64((1 << slot_bits) - 1)).astype(np.int64) for k in range(probes)]

    @classmethod
    def build(cls, languages: list[str], sets: list[np.ndarray], fallback: str | None, slot_bits: int, probes: int) -> LanguageFilters:
        slots = np.zeros((1 << slot_bits, max(1, -(-len(languages) // 64))), np.uint64)
        rate = np.zeros(len(languages))
        for i, members in enumerate(sets):
            word, bit = divmod(i, 64)
            for at in cls.positions(members, slot_bits, probes):
                slots[at, word] |= np.uint64(1 << bit)
            filled = (slots[:, word] >> np.uint64(bit)) & np.uint64(1)
            rate[i] = float(filled.mean()) ** probes
        return cls(languages, slots, rate, fallback)

    def masks(self, h: np.ndarray, probes: int) -> np.ndarray:
        bits = int(len(self.slots)).bit_length() - 1
        at = self.positions(h, bits, probes)
        out = self.slots[at[0]]
        for p in at[1:]:
            out = out & self.slots[p]
        return out

    def count(self, data: np.ndarray, off: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, hits of each language) of texts in one buffer."""
        rows = len(off) - 1
        total, hits = np.zeros(rows), np.zeros((len(self.languages), rows))
        data, off = fold(data, off)
        for n in SIZES:
            h, doc = ngrams(data, off, n)
            total += np.bincount(doc, minlength=rows)
            masks = self.masks(h, probes)
            for i in range(len(self.languages)):
                word, bit = divmod(i, 64)
                on = ((masks[:, word] >> np.uint64(bit)) & np.uint64(1)).astype(bool)
                hits[i] += np.bincount(doc[on], minlength=rows)
        return total, hits

    def predict(self, texts: pa.Array, probes: int) -> tuple[list[str], np.ndarray]:
        rows = len(texts)
        data, off = text_buffer(texts)
        count, hits = np.zeros(rows), np.zeros((len(self.languages), rows))
        for first, last, cuts in pieces(data, off, PIECE_BYTES):
            n, h = self.count(data[cuts[0] : cuts[-1]], cuts - cuts[0], probes)
            count[first:last] += n
            hits[:, first:last] += h
        f = self.false_rate[:, None]
        corrected = np.maximum((hits - f * count) / np.maximum(1 - f, 1e-12), 0)
        names, scores = [], np.zeros(rows)
        best = corrected.argmax(axis=0) if len(self.languages) else np.zeros(rows, int)
        for i, t in enumerate(texts):
            t = t.as_py()
            if not self.languages or t is None or not _LETTER(t):
                names.append(UNKNOWN)
            elif corrected[best[i], i] <= 0:
                names.append(self.fallback)
            else:
                names.append(self.languages[best[i]])
                scores[i] = min(1.0, corrected[best[i], i] / count[i])
        return names, scores


def added_up(grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, in order, each with the sum of its times."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(times[order], first) if len(first) else times


class GramCounts:
    """Counts of n-grams by (language, length), added up over a task's batches."""

    def __init__(self) -> None:
        self.parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, names: list[str], texts: pa.Array) -> None:
        order = sorted(range(len(names)), key=names.__getitem__)  # rows of a language side by side
        ordered = [names[i] for i in order]
        data, off = folded(texts.take(pa.array(order, pa.int64())))
        starts = [i for i, x in enumerate(ordered) if not i or x != ordered[i - 1]]
        for n in SIZES:
            h, doc = ngrams(data, off, n)
            at = np.searchsorted(doc, [*starts, len(ordered)])
            for i, a, b in zip(starts, at[:-1], at[1:], strict=True):
                if a < b:
                    grams, times = np.unique(h[a:b], return_counts=True)
                    self.parts.setdefault((ordered[i], n), []).append((grams, times))
                    self.held += len(grams)

    def merge(self) -> None:
        for key, parts in self.parts.items():
            if len(parts) > 1:
                self.parts[key] = [added_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        self.held = sum(len(g) for parts in self.parts.values() for g, _ in parts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for (name, n), [(grams, times)] in self.parts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))],
                names=["lang", "size", "gram", "times"],
            )
        self.parts, self.held = {}, 0


def with_language(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.where("lang IS NOT NULL AND text IS NOT NULL")


def learn(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_share: float = MIN_SHARE,
    slot_bits: int = SLOT_BITS,
    probes: int = PROBES,
) -> LanguageFilters:
    """Filters from all rows with text and a language."""
    rows = with_language(labelled, lang_col, text_col)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters.build([], [], None, slot_bits, probes)
    slot_bits -= max(0, (len(languages) - 1) // WIDE).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()
        for b in by_bytes(batches, "text", BATCH_BYTES):
            counts.add(b.column(0).to_pylist(), b.column(1))
            if counts.held > HELD_GRAMS:
                counts.merge()
                if counts.held > HELD_GRAMS // 2:
                    yield from counts.batches()
        yield from counts.batches()

    counted = map_arrow(rows, count, "lang string, size int, gram long, times long")
    grams = counted.groupBy("lang", "size", "gram").agg(F.sum("times").alias("times"))
    totals = grams.groupBy("lang", "size").agg(F.sum("times").alias("total"))
    shares = grams.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("times") / F.col("total"))
    shares = shares.where(F.col("share") >= min_share)
    # at most len(SIZES) / min_share n-grams a language reach the driver
    kept = shares.select("lang", "gram").toPandas()
    sets = [kept.loc[kept["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in languages]
    return LanguageFilters.build(languages, sets, max(languages, key=lambda x: (sizes[x], x)), slot_bits, probes)


def predict(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", probes: int = PROBES) -> DataFrame:
    """``docs`` with two more columns, ``lang_pred`` and ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** slot_bits words for each 64 languages
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index(text_col)}"
    plain = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, BATCH_BYTES):
            lang, score = model.value.predict(b.column(plain.index(text)), probes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*plain, "lang_pred", "score"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in inner.schema], "lang_pred string, score double"])
    out = map_arrow(inner, run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")


def learn_bound(labelled: DataFrame, filters: LanguageFilters, lang_col: str = "lang", text_col: str = "text", share: float = BOUND_SHARE) -> float:
    """Score below which a text is taken to be in none of the languages: half of the
    score that all but ``share`` of the labelled rows with a known language reach
    (0 if there are none). All labelled rows are scored; the score is the exact one of
    its rank, found by a histogram and then inside its bucket."""
    told = predict(with_language(labelled, lang_col, text_col), filters).where(F.col("lang_pred") != UNKNOWN)
    scores = materialize(told.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "language-scores")
    bucket = F.floor(F.col("score") * SCORE_STEPS)
    histogram = sorted((r.b, r.n) for r in scores.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect())  # SCORE_STEPS + 1 rows
    rest = max(1, math.ceil(share * sum(n for _, n in histogram)))
    for b, n in histogram:
        if rest <= n:
            through = F.sum("n").over(Window.partitionBy(bucket).orderBy("score"))
            inside = scores.where(bucket == b).select("score", through.alias("through"))
            return inside.where(F.col("through") >= rest).agg(F.min("score")).first()[0] / 2
        rest -= n
    return 0.0


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 by division by 4 (false for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
