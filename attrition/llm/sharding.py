"""Operator 8: sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. The groups, in the order of
their text hash, are cut into ``shards`` consecutive runs so that the largest
run has as few bytes as possible: the smallest capacity is searched by
bisection, and a capacity is feasible when filling shards greedily, each up to
the last group that fits, takes no more than the allowed number of them.

The groups' running byte totals are computed by hash bucket (the hash spreads
groups evenly) plus the totals of the buckets before. Greedy filling only needs
"the last total not above x"; the driver answers that from a summary of bounded
size: the space of totals is divided into ``cells`` equal cells, each with the
least and largest total in it. With x inside a cell the answer is an interval,
so every capacity is feasible, infeasible or open. When open ones remain, the
summary is made again, only for the parts of the space that their cuts can
reach, with finer cells, until a single capacity is left; every round narrows
the cells at least tenfold. The search is exact and sees all groups.

The cuts are hash values, so a row's shard is a comparison with at most
``shards - 1`` constants and a group of copies needs no join. Slots number the
rows of a shard by (hash class of the id, id): rows are numbered inside classes
and shifted by the sizes of earlier classes, so no shard is one task.

Defined results: null text counts as empty (8 bytes; checksum 0, and one group
with empty texts). Texts whose 64-bit hashes collide are one group. Repeated
rows each take a slot. Shards may stay empty when there are few groups; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.llm.common import materialize, table

SHARDS = 24
OVERHEAD = 8
CELLS = 1 << 15
GROUPS_PER_BUCKET = 100_000
ROWS_PER_CLASS = 100_000


@dataclass
class Summary:
    """Least and largest total of the known cells, in order. Nothing is asked
    between the regions that a round looked at."""

    least: list[int]
    most: list[int]

    def last_up_to(self, x: int) -> tuple[int, int]:
        """Bounds of the largest total not above ``x`` (0 is always a total)."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0, 0
        return (self.most[i], self.most[i]) if self.most[i] <= x else (self.least[i], x)


def fill(summary: Summary, capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Greedy cuts for a capacity: lower and upper bounds of each cut."""
    low, high = [0], [0]
    for _ in range(shards):
        low.append(summary.last_up_to(low[-1] + capacity)[0])
        high.append(summary.last_up_to(high[-1] + capacity)[1])
    return low, high


def bisect(summary: Summary, total: int, shards: int, least: int, most: int) -> tuple[int, int]:
    """(largest capacity known infeasible, smallest known feasible) in (least, most]."""
    a, b = least, most  # below: smallest feasible by the pessimistic cuts
    while b - a > 1:
        c = (a + b) // 2
        a, b = (a, c) if fill(summary, c, shards)[0][-1] >= total else (c, b)
    feasible, a = b, least
    while b - a > 1:  # largest infeasible even by the optimistic cuts
        c = (a + b) // 2
        a, b = (a, c) if fill(summary, c, shards)[1][-1] >= total else (c, b)
    return a, feasible


def running_totals(groups: DataFrame) -> DataFrame:
    """``groups`` (``key`` long, ``bytes`` long) with ``total``: bytes of all groups up to and including this one."""
    n = groups.count()
    bits = max(1, (n // GROUPS_PER_BUCKET).bit_length())
    bucketed = groups.withColumn("bucket", F.shiftright("key", 64 - bits))
    inside = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("bucket").agg(F.sum("bytes").alias("size"))  # one row for each GROUPS_PER_BUCKET groups
    sizes = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    summed = bucketed.withColumn("local", F.sum("bytes").over(inside)).join(sizes, "bucket")
    return summed.select("key", "bytes", (F.col("local") + F.col("before")).alias("total"))


def summarize(totals: DataFrame, regions: list[tuple[int, int]], cells: int) -> Summary:
    """Least and largest total of the cells of each region [from, to]; at most
    ``cells`` plus two rows a region reach the driver."""
    share = -(-cells // len(regions))
    cell = F.lit(None).cast("long")
    where = F.lit(False)
    for a, b in regions:
        width = -(-(b - a + 1) // share)
        inside = F.col("total").between(a, b)
        where = where | inside
        cell = F.when(inside, F.lit(a) + F.floor((F.col("total") - F.lit(a)) / F.lit(width)).cast("long") * F.lit(width)).otherwise(cell)
    got = totals.where(where).groupBy(cell.alias("cell")).agg(F.min("total").alias("least"), F.max("total").alias("most")).orderBy("cell").collect()
    ends = [a for a, _ in regions]
    # the last total before each region and the last of all are known exactly too
    edges = totals.agg(F.max("total"), *[F.max(F.when(F.col("total") < a, F.col("total"))) for a in ends]).first()
    rows = sorted({*((r.cell, r.least, r.most) for r in got), *((e, e, e) for e in edges if e is not None)})
    return Summary([r[1] for r in rows], [r[2] for r in rows])


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest largest-run size of ``groups`` (``key, total, bytes``)
    and the totals at which the first ``shards - 1`` runs end."""
    total, biggest = groups.agg(F.max("total"), F.max("bytes")).first()
    if total is None:
        return 0, []
    least, most = max(-(-total // shards), biggest) - 1, total
    cells = max(cells, 8 * shards * shards)  # fewer might not narrow the search
    regions = [(1, total)]
    while True:
        summary = summarize(groups, regions, cells)
        least, most = bisect(summary, total, shards, least, most)
        lower = most if most - least == 1 else least  # capacity found: only its own cuts are left to place
        low, high = fill(summary, lower, shards)[0], fill(summary, most, shards)[1]
        if lower == most and low == high:
            return most, high[1:shards]
        reach = sorted((max(1, a + lower), min(total, b + most)) for a, b in zip(low, high, strict=True) if a + lower <= total)
        regions = []
        for a, b in reach:
            if regions and a <= regions[-1][1] + 1:
                regions[-1] = (regions[-1][0], max(b, regions[-1][1]))
            else:
                regions.append((a, b))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = materialize(running_totals(materialize(groups, "shard-groups")), "shard-totals")
    _, cuts = minimax_cuts(groups, shards, cells)
    ends = sorted(r.key for r in groups.where(F.col("total").isin(cuts)).select("key").collect())  # at most shards - 1 rows
    key = F.col("key")
    shard = sum((F.when(key > F.lit(e), 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard)
    n = docs.count()
    classes = max(1, -(-n // (shards * ROWS_PER_CLASS)), 8)
    placed = placed.withColumn("class", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(classes)).cast("int"))
    inside = Window.partitionBy("shard", "class").orderBy("id", "size", "text_crc32", "key")
    before = Window.partitionBy("shard").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "class").agg(F.count(F.lit(1)).alias("rows"))  # shards x classes rows
    sizes = sizes.select("shard", "class", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    numbered = placed.withColumn("local", F.row_number().over(inside)).join(sizes, ["shard", "class"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("local") - 1 + F.col("before")).cast("long").alias("slot"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op8_minimax_shards": op8_minimax_shards}
