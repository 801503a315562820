"""Operator 4: near-duplicate detection by SimHash with deletion-variant signatures.

Fingerprint: the bits set in more than half of the XXH64 hashes of a text's
word shingles (repeats count).

Links: with at most ``bits`` = 2 differing bits, two halves are cut, so that at
least one half differs by at most one bit. Each half is indexed with every one
of its 32 bits deleted; an equality join on (half, deleted bit, remaining 31
bits) meets every linked pair, and the whole fingerprints are compared. Only
distinct fingerprints are indexed (a group of copies is one row), and a
fingerprint has at most 2,080 others within two bits, so links grow with the
number of distinct fingerprints.

Signatures shared by more than ``hot`` fingerprints are not joined pairwise:
their members are indexed again with a second bit deleted. Members that agree
on the remaining 62 bits differ in at most two, so each such set is linked as a
star to its smallest member. That is exact for any size.

Components of the links between fingerprints come from star contraction
(``components``); a component is named by the smallest id of its documents.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle of the whole sequence.
Repeated rows each get their row. A null id is in no component: its
``component_id`` is null, and it links nothing. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, checkpointed, map_arrow, materialize, table
from attrition.llm.components import components

SHINGLE = 3
BITS = 2
HOT = 2_000
BATCH_BYTES = 4 << 20
SEED = 42


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes; 0 for no words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp): the 64-bit fingerprint of every whole text as a signed long,
    and a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            fps = [fingerprint((t or "").encode().lower().split(), shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "mark", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), text_mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, f"id {picked.schema['id'].dataType.simpleString()}, mark long, fp long")


def text_mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _signature(fp: Column, half: int, bit: Column) -> Column:
    """Half ``half`` of the fingerprint without bit ``bit`` of it, with both
    numbers in the free upper bits."""
    part = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << 32) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    head = F.shiftleft((bit + F.lit(64 * half)).cast("long"), 32)
    return part.bitwiseAND(F.bitwise_not(one)).bitwiseOR(head)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different ``fp`` values of ``distinct`` that connect all
    fingerprints within two bits: every such pair, except that the members of a
    hot signature are linked as stars (which connects the same ones)."""
    fp, bit = F.col("fp"), F.col("bit")
    # each row becomes 64, so the rows are spread first
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    variants = variants.select("fp", F.explode(F.array(_signature(fp, 0, bit), _signature(fp, 1, bit))).alias("sig"))
    # Most shared signatures have two members, which the aggregate itself returns;
    # only the variants of larger ones are looked up again.
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    counts = variants.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counts = materialize(counts.where("members > 1"), "signature-counts")
    twos = counts.where((F.col("members") == 2) & near).select("a", "b")
    shared = materialize(variants.join(counts.where("members > 2").select("sig", "members"), "sig"), "signatures")
    few = shared.where(F.col("members") <= hot)
    left = few.select("sig", F.col("fp").alias("a"))
    right = few.select(F.col("sig").alias("sig_b"), F.col("fp").alias("b"))
    pairs = left.join(right, (F.col("sig") == F.col("sig_b")) & (F.col("a") < F.col("b")) & near).select("a", "b").unionAll(twos)

    # Hot signatures: delete a second bit. With the first deleted bit in one half,
    # the second lies in the other half; pairs whose first half is equal may
    # differ in two bits of the other, and are taken up where bit 0 is deleted.
    many = shared.where(F.col("members") > max(hot, 2))
    first = F.shiftrightunsigned(F.col("sig"), 32).cast("int")
    half, bit = F.shiftright(first, 6), first.bitwiseAND(F.lit(31))
    own = (half * F.lit(32) + bit).alias("own")
    other = (F.lit(1) - half) * F.lit(32)
    two = many.select("fp", "sig", own, other.alias("other"), bit.alias("bit")).select(
        "fp", "sig", "own", "other", "bit", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    )
    mask = lambda *bits: F.expr(" | ".join(f"shiftleft(1L, {b})" for b in bits))
    across = two.select("fp", "sig", mask("own", "other + i").alias("mask"))
    within = (
        two.where("bit = 0")
        .select("fp", "sig", "other", "i", F.explode(F.expr("sequence(0, 31)")).alias("j"))
        .where("i < j")
        .select("fp", "sig", mask("other + i", "other + j").alias("mask"))
    )
    sets = across.unionAll(within).withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    stars = sets.groupBy("sig", "mask", "rest").agg(F.min("fp").alias("a"))
    hot_links = sets.join(stars, ["sig", "mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(hot_links).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, mark, fp, root, component) for every row of ``docs``: its component's
    smallest fingerprint and smallest id."""
    fps = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    first = fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first"))
    first = materialize(first, "distinct-fingerprints")
    found = components(links(first.select("fp"), hot))
    named = first.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = materialize(named, "components")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select(F.col("fp").alias("of"), "root", F.col("least").alias("component"))
    joined = fps.join(named, F.col("fp") == F.col("of"), "left")
    known = F.col("id").isNotNull()
    return joined.select("id", "mark", "fp", F.when(known, F.col("root")).alias("root"), F.when(known, F.col("component")).alias("component"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest id, and of several rows
    of that id the one with the smallest text hash. Rows with null id stay."""
    found = near_duplicates(docs, shingle, id_col, text_col).where("id IS NOT NULL")
    stay = found.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("row")).select("row.*")
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    marked = inner.withColumn("mark", text_mark(text))
    one = marked.join(stay.withColumnRenamed("id", ident), [ident, "mark"]).dropDuplicates([ident, "mark"])
    out = one.select(*inner.columns).unionAll(inner.where(F.col(ident).isNull()))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
