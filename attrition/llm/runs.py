"""Operator 12: periodic runs of words.

A run is a stretch of words that repeats a block of ``period`` words (its smallest
period), is at least ``max(min_length, min_exponent * period)`` words long and cannot
be made longer on either side. All runs of a text are found with an enhanced suffix
array, without a tree:

1. *Suffix array* of each document's words by prefix doubling; only suffixes that are
   not alone yet are sorted again. The ranks of each round are kept: they give the
   common prefix (LCP) of neighbouring suffixes by steps of halving powers of two.
2. *LCP intervals.* A border of the array with LCP ``d`` parts the suffixes that share
   at least ``d`` words into the child on its left and what follows on its right. The
   interval's bounds are the nearest smaller values, read off a pyramid of minima.
3. *Branching tandems.* For each suffix ``i`` of the smaller side, the inverse array
   (ISA) tells whether ``i + d`` or ``i - d`` stands on the other side. If so, a square
   of two blocks of ``d`` words starts there and does not go on to the right. As a
   suffix is listed only on smaller sides, there are n log n such tests. More copies
   to the left are asked of ISA in the same way, up to ``min_exponent``.
4. *Rotation.* A square is rotated left while the words agree, which gives the start of
   its run; the square's end is the run's end. Of squares with one end, those whose
   block is itself a repeated block fall to the run of the shorter period.

A document is one value, so one task holds its arrays (some 100 bytes a word, or
20 bytes a byte of text, and 4 bytes a word for each doubling); documents are taken
together up to ``BATCH_BYTES``. Words are compared by 64-bit hashes. Nothing is
shuffled.

Defined results: null text has no words and no runs; equal rows have equal runs; a null
id is kept; other columns pass through, whatever their names; an empty table gives an
empty result. Overlapping runs of several periods are all reported.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import Words, by_bytes, expand, map_arrow, split_words, table, text_buffer

MIN_LENGTH = 6
MIN_EXPONENT = 4.0
BATCH_BYTES = 2 << 20
DIGEST_WORDS = 1 << 18


def suffix_array(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks of each doubling round) of consecutive
    documents. Suffixes end with their document; documents stay in their order."""
    n = len(codes)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    sa = np.argsort(key, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:n] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    rounds = [rank.copy()]
    slots = np.flatnonzero(~(new[:-1] & new[1:]))
    step = 1
    while len(slots):
        at = sa[slots]
        ahead = at + step
        inside = ahead < end[at]
        follow = np.where(inside, rank[np.where(inside, ahead, 0)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[slots] = at[order]
        fresh = np.ones(len(slots) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        rank[sa[slots]] = np.maximum.accumulate(np.where(fresh[:-1], slots, 0))
        rounds.append(rank.copy())
        slots = slots[~(fresh[:-1] & fresh[1:])]
        step *= 2
    return sa, rank, rounds


def common_prefixes(sa: np.ndarray, first: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it (0 where
    that is another document's or there is none)."""
    n = len(sa)
    lcp = np.zeros(n, np.int32)
    pairs = np.flatnonzero(rounds[0][sa[1:]] == rounds[0][sa[:-1]]) + 1 if n else np.zeros(0, np.int64)
    a, b = sa[pairs - 1], sa[pairs]
    stop = first[np.searchsorted(first, np.maximum(a, b), side="right")]  # end of the document
    for level in range(len(rounds) - 1, -1, -1):
        live = np.flatnonzero(np.maximum(a, b) < stop)
        same = live[rounds[level][a[live]] == rounds[level][b[live]]]
        a[same] += 1 << level
        b[same] += 1 << level
    lcp[pairs] = a - sa[pairs - 1]
    return lcp


def nearest_before(values: np.ndarray, at: np.ndarray, strict: bool) -> np.ndarray:
    """For each index of ``at`` the nearest index before it with a value that is smaller
    (``strict``) or not larger; -1 where there is none."""
    pyramid = [values]
    while len(pyramid[-1]) > 1:
        low = pyramid[-1]
        if len(low) % 2:
            low = np.append(low, np.iinfo(low.dtype).max)
        pyramid.append(low.reshape(-1, 2).min(axis=1))
    meets = np.less if strict else np.less_equal
    bound = values[at]
    out = np.full(len(at), -1, np.int64)
    node = at.astype(np.int64)
    live = np.arange(len(at))
    found: list[np.ndarray] = []
    for level in pyramid:  # up, until a left neighbour's minimum meets the bound
        mine = node[live]
        hit = (mine & 1 == 1) & meets(level[np.maximum(mine - 1, 0)], bound[live])
        out[live[hit]] = mine[hit] - 1
        found.append(live[hit])
        live = live[~hit]
        node[live] >>= 1
    down = np.zeros(0, np.int64)
    for k in range(len(pyramid) - 1, 0, -1):  # and down to the last value that does
        down = np.concatenate([down, found[k]])
        right = 2 * out[down] + 1
        low = pyramid[k - 1]
        there = right < len(low)
        there &= meets(low[np.where(there, right, 0)], bound[down])
        out[down] = right - ~there
    return out


def branching_tandems(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all stretches of ``copies`` equal blocks that another copy of
    the block's first word does not follow."""
    n = len(sa)
    borders = np.flatnonzero(lcp > 0)
    if not len(borders):
        return borders, borders
    lo = nearest_before(lcp, borders, strict=False)
    hi = n - 1 - nearest_before(lcp[::-1], n - 1 - borders, strict=True)
    # the last copies share their block, and all but the last one two blocks
    wide = (hi - lo >= copies) & (np.maximum(borders - lo, hi - borders) >= copies - 1)
    borders, lo, hi = borders[wide], lo[wide], hi[wide]
    left = borders - lo <= hi - borders
    size = np.where(left, borders - lo, hi - borders)
    begin = np.where(left, lo, borders)
    starts, periods, spans = [], [], []
    for part in np.array_split(np.arange(len(borders)), int(size.sum()) // 4_000_000 + 1):
        row = np.repeat(part, size[part])
        i = sa[expand(begin[part], size[part])]
        depth = lcp[borders[row]].astype(np.int64)
        other_lo = np.where(left[row], borders[row], lo[row])
        other_hi = np.where(left[row], hi[row], borders[row])
        for sign in (1, -1):
            j = i + sign * depth
            ok = (j >= 0) & (j < n)
            place = isa[np.where(ok, j, 0)]
            ok &= (place >= other_lo) & (place < other_hi)
            starts.append(np.minimum(i, j)[ok])
            periods.append(depth[ok])
            spans.append(row[ok])
    start, period, row = np.concatenate(starts), np.concatenate(periods), np.concatenate(spans)
    for _ in range(copies - 2):  # one more copy to the left each time
        before = start - period
        ok = before >= 0
        place = isa[np.where(ok, before, 0)]
        ok &= (place >= lo[row]) & (place < hi[row])
        start, period, row = before[ok], period[ok], row[ok]
    return start, period


def rotate_left(codes: np.ndarray, start: int, least: int, period: int) -> int:
    """Smallest start to which a square at ``start`` can be rotated."""
    width = 16
    while start > least:
        width = min(width, start - least)
        differ = np.flatnonzero(codes[start - width : start] != codes[start - width + period : start + period])
        if len(differ):
            return start - width + int(differ[-1]) + 1
        start -= width
        width *= 2
    return start


@dataclass
class Runs:
    """Runs of a batch, by document, start and period; ``start`` counts in the document."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    def of(self, doc: int) -> slice:
        return slice(*np.searchsorted(self.doc, [doc, doc + 1]).tolist())


def find(codes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> Runs:
    """All runs of consecutive documents of word codes."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    copies = math.floor(min_exponent)
    sa, isa, rounds = suffix_array(codes, first)
    lcp = common_prefixes(sa, first, rounds)
    del rounds
    start, period = branching_tandems(sa, isa, lcp, copies)
    end = start + copies * period
    order = np.lexsort((period, end))
    doc = np.searchsorted(first, start, side="right") - 1
    rows: list[tuple[int, int, int, int]] = []
    same_end: list[tuple[int, int]] = []
    last = -1
    for k, s, q, e in zip(doc[order].tolist(), start[order].tolist(), period[order].tolist(), end[order].tolist(), strict=True):
        if e != last:
            same_end, last = [], e
        if any(q % shorter == 0 and begin <= s for begin, shorter in same_end):
            continue  # a block that is itself repeated: the run of the shorter period holds it
        begin = rotate_left(codes, s, int(first[k]), q)
        same_end.append((begin, q))
        if e - begin >= max(min_length, min_exponent * q):
            rows.append((k, begin - int(first[k]), e - begin, q))
    rows.sort(key=lambda r: (r[0], r[1], r[3]))
    table_ = np.array(rows, np.int64).reshape(-1, 4)
    return Runs(*(table_[:, c] for c in range(4)))


def covered(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Words that some run contains after its first period."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    base = first[runs.doc]
    np.add.at(edge, base + runs.start + runs.period, 1)
    np.add.at(edge, base + runs.start + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def joined(words: Words, at: np.ndarray) -> bytes:
    """The words at ``at``, joined by one blank."""
    if not len(at):
        return b""
    size = words.end[at] - words.start[at] + 1
    out = words.data[np.minimum(expand(words.start[at], size), len(words.data) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


Reorder = Callable[[np.ndarray, object], np.ndarray]


def batch_runs(b: pa.RecordBatch, text: int, min_length: int, min_exponent: float, reorder: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None):
    """(words, order of the words, runs) of a batch's documents."""
    words = split_words(*text_buffer(b.column(text)))
    order = np.arange(len(words.start)) if reorder is None else reorder(b, words.first)
    _, codes = np.unique(words.hash, return_inverse=True)
    return words, order, find(codes[order], words.first, min_length, min_exponent)


def _renamed(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return inner, names.index(text_col)


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT, runs_col: str = "runs") -> DataFrame:
    """``docs`` with ``runs_col``: its runs (start, length, period), by start and period."""
    inner, text = _renamed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, f"c{text}", BATCH_BYTES):
            words, _, runs = batch_runs(b, text, min_length, min_exponent)
            fields = [pa.array(x, pa.int64()) for x in (runs.start, runs.length, runs.period)]
            off = np.searchsorted(runs.doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "runs"])

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in inner.schema]
    out = map_arrow(inner, run, ", ".join([*schema, "runs array<struct<start: long, length: long, period: long>>"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("runs").alias(runs_col))


def collapse_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """``docs`` with each run cut down to its first period: changed texts are the kept
    words joined by one blank, others (null too) stay as they were. New column
    ``n_dropped``: words cut out."""
    inner, text = _renamed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, f"c{text}", BATCH_BYTES):
            words, _, runs = batch_runs(b, text, min_length, min_exponent)
            gone = covered(runs, words.first)
            total = np.concatenate([[0], np.cumsum(gone)])
            dropped = total[words.first[1:]] - total[words.first[:-1]]
            texts = b.column(text).to_pylist()
            for i in np.flatnonzero(dropped).tolist():
                x, y = words.first[i], words.first[i + 1]
                texts[i] = joined(words, x + np.flatnonzero(~gone[x:y])).decode()
            columns = list(b.columns)
            columns[text] = pa.array(texts, b.column(text).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int64())], names=[*b.schema.names, "n_dropped"])

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in inner.schema]
    out = map_arrow(inner, run, ", ".join([*schema, "n_dropped long"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "n_dropped")


def planted(b: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Order of words that the query's contract sets: every tenth document (by the
    CRC-32 of its decimal id) repeats a block from some word on."""
    order = np.arange(int(first[-1]))
    for k, ident in enumerate(b.column(0).to_pylist()):
        n = int(first[k + 1] - first[k])
        if ident is None or not n:
            continue
        h = zlib.crc32(str(ident).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return order


def run_digests(docs: DataFrame, reorder: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per document (``doc_id``, ``text``): number of runs, the longest run (ties: least
    start, then period), and SHA-256 of all runs and of the words that collapsing keeps.
    ``reorder`` may change the order of a batch's words."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            words, order, runs = batch_runs(b, 1, MIN_LENGTH, MIN_EXPONENT, reorder)
            gone = covered(runs, words.first)
            rows = []
            for k in range(b.num_rows):
                mine = runs.of(k)
                each = list(zip(runs.start[mine].tolist(), runs.length[mine].tolist(), runs.period[mine].tolist(), strict=True))
                best = min(each, key=lambda r: (-r[1], r[0], r[2])) if each else (None, None, None)
                milli = 1000 * best[1] // best[2] if each else None
                listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in each).encode())
                kept = hashlib.sha256()
                x, y = int(words.first[k]), int(words.first[k + 1])
                stay = x + np.flatnonzero(~gone[x:y])
                for i in range(0, len(stay), DIGEST_WORDS):
                    kept.update((b" " if i else b"") + joined(words, order[stay[i : i + DIGEST_WORDS]]))
                rows.append((len(each), *best, milli, listed.hexdigest(), kept.hexdigest()))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    numbers = "n_runs long, start long, length long, period long, exponent_milli long"
    return map_arrow(picked, run, f"doc_id {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
