"""Operator 7: benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of bytes other than white space and ASCII punctuation;
each character of a script written without spaces is one. Windows of ``SPAN`` = 10
tokens are hashed under ten fixed masks; the span is five pairs of positions, and
each mask ignores two of the pairs. Any two positions lie in two pairs or in one, so
a window that differs from a benchmark window in at most two tokens has the same
hash under some mask.

Items of fewer than ``MIN_LENGTH`` tokens are hashed whole. At least 4 of 5 of their
tokens must be equal, so e = n div 5 may differ; their positions are cut into e + 2
blocks and each mask ignores e of them (none for items under 5 tokens).

The seeds (hash, item) are a table. One pass over the documents keeps, of each, the
hashes that a Bloom filter of the seeds lets through and, where there are any, the
document's tokens. These hashes are joined with the seeds, which gives pairs of
texts and items; each pair is verified. For a long item every hit fixes an alignment;
along it the longest stretch around the hit is taken that begins and ends with equal
tokens and has at least ``SHARE`` of them equal. It is an overlap if it has
``MIN_EQUAL`` equal tokens and is ``MIN_LENGTH`` long. A short item overlaps where the
share of all its tokens is equal.

Neither documents nor the benchmark go through the driver: it reads three numbers and
the filter, at most ``2 ** FILTER_BITS`` bits (32 MB), which is also all that is
broadcast by hint; tables are broadcast only where Spark finds them small. Beyond that
the filter lets more through and the join does more. Equal documents are joined and
verified once, items are verified in bundles of about ``BUNDLE`` tokens.

Items of fewer than ``min_tokens`` tokens are not searched (``left_out`` lists them): a
document must not go for one common word. The default is ``MIN_TOKENS``.

Defined results: null and empty texts overlap with nothing. Of several alignments of
one item in one document the one with most equal tokens counts (ties: the first).
Repeated documents and items are reported each; null ids are carried. Empty tables
give no overlaps. Other columns pass through ``decontaminate`` whatever their names.
Long texts and items are taken whole; words are split ``common.PIECE_BYTES`` at a time,
and a task holds some 8 bytes a token for a text and the hashes of one mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import Words, by_bytes, map_arrow, materialize, mix64, split_words, table, text_buffer

SPAN = 10
MASKS = [[p for p in range(SPAN) if p // 2 not in pair] for pair in combinations(range(SPAN // 2), 2)]
SHARE_EQUAL, SHARE_OF = 4, 5  # at least 4 of 5 tokens equal
MIN_EQUAL = 10
MIN_LENGTH = 12
MIN_TOKENS = 3
BATCH_BYTES = 1 << 20
FILTER_BITS = 28
BITS_A_SEED = 256
PROBES = 4
BUNDLE = 1 << 19
HITS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def short_masks(n: int) -> list[list[int]]:
    """Positions of each mask over a whole item of ``n`` < ``MIN_LENGTH`` tokens."""
    differ = n * (SHARE_OF - SHARE_EQUAL) // SHARE_OF
    block = [p * (differ + 2) // n for p in range(n)]
    return [[p for p in range(n) if block[p] not in left] for left in combinations(range(differ + 2 if differ else 1), differ)]


def masked(h: np.ndarray, positions: list[int], span: int, tag: int) -> np.ndarray:
    """Hash of every window of ``span`` tokens at the positions."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(tag))
    for p in positions:
        out *= _STEP
        out += h[p : p + n]
    return mix64(out)


def seed_hashes(h: np.ndarray, mask: int) -> np.ndarray:
    """Hash of every window of ``SPAN`` tokens under a mask."""
    return masked(h, MASKS[mask], SPAN, mask + 1)


def short_hashes(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Hashes of every window of ``n`` tokens under each mask of whole items of that length."""
    for m, positions in enumerate(short_masks(n)):
        yield masked(h, positions, n, n << 8 | m + 1)


def item_hashes(tokens: np.ndarray) -> Iterator[np.ndarray]:
    if len(tokens) >= MIN_LENGTH:
        yield from (seed_hashes(tokens, m) for m in range(len(MASKS)))
    elif len(tokens):
        yield from short_hashes(tokens, len(tokens))


@dataclass
class Overlap:
    item: int
    equal: int
    length: int
    item_from: int
    doc_from: int


def stretch(equal: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """The longest [from, to) around [a, b) that starts and ends with an equal token
    and has at least the share of equal ones; (0, 0) if there is none."""
    gain = np.where(equal, SHARE_OF - SHARE_EQUAL, -SHARE_EQUAL)
    total = np.concatenate([[0], np.cumsum(gain)])
    starts = np.flatnonzero(equal[: a + 1]) if a < len(equal) else np.zeros(0, int)
    ends = np.flatnonzero(equal[b - 1 :]) + b
    first_in = a + int(np.argmax(equal[a:b]))
    last_in = b - int(np.argmax(equal[a:b][::-1]))
    if not equal[a:b].any():
        return 0, 0
    starts = np.append(starts, first_in) if first_in > a else starts
    ends = np.insert(ends, 0, last_in) if last_in < b else ends
    # the farthest end of each start: the last one from which on some total is high enough
    high = np.maximum.accumulate(total[ends][::-1])[::-1]
    last = np.searchsorted(-high, -total[starts], side="right") - 1
    if last.max(initial=-1) < 0:
        return 0, 0
    length = np.where(last >= 0, ends[last] - starts, 0)
    i = int(length.argmax())
    return int(starts[i]), int(ends[last[i]])


def hits(text: np.ndarray, items: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows (item, item start in the text, item position) of windows of long items with a
    hash in common with the text's, about ``HITS`` at a time, in order of the text."""
    long = [i for i, t in enumerate(items) if len(t) >= MIN_LENGTH]
    if not long or len(text) < SPAN:
        return
    found = []
    for m in range(len(MASKS)):
        h = np.concatenate([seed_hashes(items[i], m) for i in long])
        size = [len(items[i]) - SPAN + 1 for i in long]
        item, at = np.repeat(long, size), np.concatenate([np.arange(n) for n in size])
        order = np.argsort(h, kind="stable")
        h, item, at = h[order], item[order], at[order]
        mine = seed_hashes(text, m)
        low, high = (np.searchsorted(h, mine, side) for side in ("left", "right"))
        pos = np.flatnonzero(high > low)
        found.append((pos, low[pos], high[pos] - low[pos], item, at))
    load = np.zeros(len(text) + 1, np.int64)
    for pos, _, k, _, _ in found:
        load[pos + 1] += k
    np.cumsum(load, out=load)
    a = 0
    while a < len(text) and load[a] < load[-1]:
        b = max(a + 1, int(np.searchsorted(load, load[a] + HITS, side="right")) - 1)
        rows = []
        for pos, low, k, item, at in found:
            x, y = np.searchsorted(pos, [a, b])
            n = k[x:y]
            seed = np.arange(int(n.sum())) + np.repeat(low[x:y] - (np.cumsum(n) - n), n)
            rows.append(np.stack([item[seed], np.repeat(pos[x:y], n) - at[seed], at[seed]], axis=1))
        yield np.unique(np.concatenate(rows), axis=0)
        a = b


def whole(text: np.ndarray, tokens: np.ndarray) -> tuple[int, int] | None:
    """(equal tokens, place) of the best place of a short item, if it overlaps."""
    n = len(tokens)
    places = len(text) - n + 1
    if places <= 0 or not n:
        return None
    equal = np.zeros(places, np.int8)
    for j in range(n):
        equal += text[j : j + places] == tokens[j]
    at = int(equal.argmax())
    return (int(equal[at]), at) if equal[at] * SHARE_OF >= n * SHARE_EQUAL else None


def overlaps(text: np.ndarray, items: list[np.ndarray]) -> list[Overlap]:
    """Verified overlaps of a text (token hashes), the best of each item."""
    found: dict[int, Overlap] = {}
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for rows in hits(text, items):
        for item, shift, at in rows.tolist():
            covered = seen.setdefault((item, shift), [])
            if any(a <= at and at + SPAN <= b for a, b in covered):
                continue
            tokens = items[item]
            skip = max(0, -shift)
            upto = min(len(tokens), len(text) - shift)
            equal = tokens[skip:upto] == text[shift + skip : shift + upto]
            a, b = stretch(equal, at - skip, at - skip + SPAN)
            covered.append((a + skip, b + skip))
            same = int(equal[a:b].sum())
            if same < MIN_EQUAL or b - a < MIN_LENGTH:
                continue
            new = Overlap(item, same, b - a, a + skip, shift + skip + a)
            old = found.get(item)
            if old is None or (new.equal, -new.doc_from) > (old.equal, -old.doc_from):
                found[item] = new
    for i, tokens in enumerate(items):
        if len(tokens) < MIN_LENGTH and (best := whole(text, tokens)):
            found[i] = Overlap(i, best[0], len(tokens), 0, best[1])
    return [found[i] for i in sorted(found)]


def words_of(texts: pa.Array) -> Words:
    return split_words(*text_buffer(texts), lower=True, plain=True)


def packed(words: Words, docs: list[int]) -> pa.Array:
    return pa.array([words.hash[words.first[d] : words.first[d + 1]].tobytes() for d in docs], pa.binary())


def item_tokens(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(item, n, tokens) of each distinct text; ``item`` is its MD5."""
    texts = benchmark.select(item_key(text_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").dropDuplicates(["item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            words = words_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(words.first).astype(np.int32)), packed(words, range(b.num_rows))], names=["item", "n", "tokens"])

    return map_arrow(texts, run, "item string, n int, tokens binary")


def item_key(text: str | Column) -> Column:
    return F.md5((F.col(text) if isinstance(text, str) else text).cast("binary"))


def left_out(benchmark: DataFrame, text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Rows of the benchmark that are too short to be searched, with their number of tokens."""
    n = item_tokens(benchmark, text_col).where(F.col("n") < min_tokens).select("item", "n")
    return benchmark.withColumn("item", item_key(text_col)).join(n, "item").drop("item").withColumnRenamed("n", "n_tokens")


@dataclass
class Index:
    """Seeds of a benchmark and what the pass over the documents needs of them."""

    tokens: DataFrame  # item, n, tokens
    seeds: DataFrame  # hash, item
    bits: np.ndarray  # Bloom filter, 64-bit words
    lengths: list[int]  # of short items
    bundles: int


def slots(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    second = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * second) & np.uint64(bits - 1)


def index(benchmark: DataFrame, text_col: str, min_tokens: int, bits_max: int = FILTER_BITS) -> Index:
    tokens = materialize(item_tokens(benchmark, text_col).where(F.col("n") >= max(1, min_tokens)), "seed-items")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0), b.column(2), strict=True):
                for h in item_hashes(np.frombuffer(t.as_py(), np.uint64)):
                    h = np.unique(h)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item.as_py()] * len(h), pa.string())], names=["hash", "item"])

    seeds = materialize(map_arrow(tokens, seed, "hash long, item string"), "seeds")
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    lengths = [r.n for r in tokens.where(F.col("n") < MIN_LENGTH).select("n").distinct().collect()]  # fewer than MIN_LENGTH
    bits = 1 << min(bits_max, max(16, (seeds.count() * BITS_A_SEED).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(list(slots(b.column(0).to_numpy().view(np.uint64), bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    filled = map_arrow(seeds.select("hash"), fill, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Index(tokens, seeds, words, sorted(lengths), 1 + size // BUNDLE)


def candidates(docs: DataFrame, against: Index) -> DataFrame:
    """(id, doc, tokens, hashes) of the documents with a hash that the filter lets
    through, from columns id and text; ``doc`` is the text's MD5."""
    lengths, shared = against.lengths, docs.sparkSession.sparkContext.broadcast(against.bits)

    def passed(h: np.ndarray, span: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(h))
        for s in slots(h, len(shared.value) << 6):
            s = s[at]
            at = at[((shared.value[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool)]
        doc = np.searchsorted(words.first, at, "right") - 1
        inside = at + span <= words.first[doc + 1]
        return doc[inside], h[at[inside]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            words = words_of(b.column(1))
            found = [passed(seed_hashes(words.hash, m), SPAN, words) for m in range(len(MASKS))]
            for n in lengths:
                found += [passed(h, n, words) for h in short_hashes(words.hash, n)]
            doc, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if not len(doc):
                continue
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
            doc, h = doc[new], h[new]
            of, first = np.unique(doc, return_index=True)
            keys = [hashlib.md5(b.column(1)[d].as_py().encode()).hexdigest() for d in of.tolist()]
            hashes = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(keys), packed(words, of.tolist()), hashes], names=["id", "doc", "tokens", "hashes"])

    kind = docs.schema["id"].dataType.simpleString()
    return materialize(map_arrow(docs, run, f"id {kind}, doc string, tokens binary, hashes array<long>"), "seed-candidates")


def verified(found: DataFrame, against: Index) -> DataFrame:
    """(doc, item, equal, length, item_tokens, item_from, doc_from) of the overlaps of the
    candidates' distinct texts with the distinct items."""
    pairs = found.select("doc", F.explode("hashes").alias("hash")).distinct().join(against.seeds, "hash").select("doc", "item").distinct()
    bundle = F.pmod(F.xxhash64("item"), F.lit(against.bundles))
    items = pairs.join(against.tokens, "item").groupBy("doc", bundle.alias("bundle")).agg(F.collect_list(F.struct("item", F.col("tokens").alias("item_tokens"))).alias("items"))
    rows = found.select("doc", "tokens").dropDuplicates(["doc"]).join(items, "doc").select("doc", "tokens", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, items in zip(*b.columns, strict=True):
                names = [x["item"] for x in items.as_py()]
                tokens = [np.frombuffer(x["item_tokens"], np.uint64) for x in items.as_py()]
                doc = doc.as_py()
                for o in overlaps(np.frombuffer(text.as_py(), np.uint64), tokens):
                    out.append((doc, names[o.item], o.equal, o.length, len(tokens[o.item]), o.item_from, o.doc_from))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:2]), *(pa.array(c, pa.int32()) for c in columns[2:])],
                    names=["doc", "item", "equal", "length", "item_tokens", "item_from", "doc_from"],
                )

    schema = "doc string, item string, equal int, length int, item_tokens int, item_from int, doc_from int"
    return materialize(map_arrow(rows, run, schema), "seed-overlaps")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """(id, item, equal, length, item_tokens, item_from, doc_from) of every overlap."""
    against = index(benchmark, item_text, min_tokens)
    found = candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), against)
    names = benchmark.select(F.col(item_col).alias("name"), item_key(item_text).alias("item"))
    rows = found.select("id", "doc").join(verified(found, against), "doc").join(names, "item")
    return rows.select("id", F.col("name").alias("item"), "equal", "length", "item_tokens", "item_from", "doc_from")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` without the rows that overlap with a benchmark item."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index(text_col)}"
    against = index(benchmark, item_text, min_tokens)
    found = candidates(inner.select(F.lit(0).alias("id"), F.col(text).alias("text")), against)
    bad = verified(found, against).select("doc").distinct()
    kept = inner.join(bad, item_key(text) == bad["doc"], "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op7_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("equal").alias("n_equal"),
        F.col("length").alias("n_overlap"),
        F.col("item_tokens").alias("n_item"),
        "item_from",
        "doc_from",
    )


QUERIES = {"op7_spaced_seed_overlaps": op7_spaced_seed_overlaps}
