"""Operator 3: approximate nearest neighbours with a forest of hash prefixes.

Each of ``trees`` trees has its own random hyperplanes; a vector's signs against
them are its hash string, and a tree is the sorted array of the strings, cut
into blocks that fit a task. The cuts follow measured counts: prefixes that hold
more than ``block_rows`` strings are counted by longer ones, up to whole strings,
and neighbouring prefixes are joined up to the bound. Rows of a string that more
rows share are dealt over sub-blocks, which all take its queries; queries of a
block beyond ``probe_rows`` are dealt over copies of it. Inner products of
vectors of different length become angles by one more coordinate that brings
all candidates to the largest norm.

1. *Descent.* In every tree a query goes down to its longest matching prefix;
   the rows around its place in the sorted array are scored. That gives a first
   k-th best score.
2. *Synchronous ascent.* All trees go up to the same depth x, the deepest one at
   which a vector as near as the current k-th best shares a prefix of x bits with
   the query in at least one tree with probability ``confidence``: for angle a
   that is 1 - (1 - (1 - a / pi) ** x) ** trees. Every row below the x-bit prefix
   is scored, in all trees; none is cut off. Queries with near neighbours stay
   deep, queries without any go up as far as that needs, at last to the root,
   where the search is exact.

Equal vectors are one row of the forest. Of their ids only the ``k + 1`` smallest
can be in a result, so a group of copies of any size stays small; queries with
equal vectors share one search.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than the most
frequent one (ties: the longer), nor rows with null id. Repeated rows (one id,
one vector) count once; an id with several vectors takes part with each, as query
and candidate, and is never its own neighbour. Fewer candidates than k: all are
returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, materialize, mix64, table

NEIGHBOURS = 20
TREES = 16
BITS = 32
CONFIDENCE = 0.93
BLOCK_ROWS = 4096
PROBE_ROWS = 16384
STEP = 4  # bits by which a prefix over the bound is lengthened
SEED = 7
CHUNK = 256  # queries that one matrix product scores


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def hyperplanes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, trees * bits))


def hash_strings(unit: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(rows, trees) hash strings as integers, first bit highest."""
    signs = (unit @ planes > 0).reshape(len(unit), trees, bits)
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1).astype(np.float64) if len(flat) else np.zeros((0, 1))


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, whatever the block."""
    return (rows * query).sum(axis=1)


def best_rows(query: np.ndarray, vectors: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the k best rows for a query, ties to the smaller id."""
    score = exact(vectors, query)
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        order = at[np.lexsort((rep[at], -score[at]))[:k]]
    else:
        order = np.lexsort((rep, -score))
    return order, score[order]


class Blocks:
    """Blocks of each tree: consecutive ranges of hash strings, and the numbers of
    their sub-blocks. Made from the counts of prefixes that cover the trees."""

    def __init__(self, tree: np.ndarray, start: np.ndarray, count: np.ndarray, trees: int, block_rows: int):
        self.starts, self.first = [], []
        for t in range(trees):
            mine = np.flatnonzero(tree == t)
            mine = mine[np.argsort(start[mine])]
            n = count[mine]
            head = np.flatnonzero(np.diff((np.cumsum(n) - n) // block_rows, prepend=-1))
            parts = -(-np.add.reduceat(n, head) // (2 * block_rows))
            starts = start[mine][head]
            starts[0] = 0
            self.starts.append(starts)
            self.first.append(np.append(0, np.cumsum(parts)))

    def of_rows(self, tree: int, hashes: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """The one sub-block of each row."""
        at = np.searchsorted(self.starts[tree], hashes, "right") - 1
        low, high = self.first[tree][at], self.first[tree][at + 1]
        return low + (mix64(rep.astype(np.int64).view(np.uint64)) % (high - low).astype(np.uint64)).astype(np.int64)

    def of_ranges(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last sub-block that can hold strings of ``low`` to ``high``."""
        a, b = (np.searchsorted(self.starts[tree], x, "right") - 1 for x in (low, high))
        return self.first[tree][a], self.first[tree][b + 1] - 1


def measured_blocks(hashed: DataFrame, n: int, trees: int, block_rows: int) -> Blocks:
    """Blocks for the ``n`` rows of ``hashed`` (``hashes``: one string a tree). Each round
    counts by a longer prefix what lies below the prefixes still over the bound."""
    rows = hashed.select(F.posexplode("hashes").alias("tree", "hash"))
    bits = min(BITS, (n // block_rows).bit_length())
    cells = []
    while True:
        got = rows.groupBy("tree", F.shiftright("hash", BITS - bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        tree, cell, count = (got[c].to_numpy().astype(np.int64) for c in ("tree", "cell", "n"))
        over = (count > block_rows) & (bits < BITS)
        cells.append((tree[~over], cell[~over] << (BITS - bits), count[~over]))
        if not over.any():
            return Blocks(*(np.concatenate([c[i] for c in cells]) for i in range(3)), trees, block_rows)
        split = hashed.sparkSession.createDataFrame(pa.table({"s_tree": tree[over], "s_cell": cell[over]}))
        rows = rows.join(split, (F.col("tree") == F.col("s_tree")) & (F.shiftright("hash", BITS - bits) == F.col("s_cell")), "left_semi")
        bits = min(BITS, bits + STEP)


def search(
    vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, trees: int = TREES, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, probe_rows: int = PROBE_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row of
    ``vectors`` (``vec_id``, ``embedding``) for which ``queries`` (on ``vec_id``) holds."""
    good = vectors.select("vec_id", F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()
    dims = good.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], result)
    dim = dims.dim
    good = good.where(F.size("vec") == dim).withColumn("vh", F.xxhash64("vec"))

    # The k + 1 smallest ids of equal vectors; the limit is applied before the shuffle.
    same = Window.partitionBy("vh", "vec")
    members = good.withColumn("place", F.row_number().over(same.orderBy("vec_id"))).where(F.col("place") <= k + 1)
    members = materialize(members.withColumn("rep", F.min("vec_id").over(same)).select("vh", "vec", "vec_id", "place", "rep"), "ann-members")
    distinct = members.where("place = 1").select("rep", "vh", "vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()

    spark = vectors.sparkSession
    planes = spark.sparkContext.broadcast(hyperplanes(dim, trees, BITS))  # (dim + 1) x trees x BITS numbers

    def index(batches):
        for b in batches:
            rows = matrix(b.column(1)) / longest
            extra = np.sqrt(np.maximum(0, 1 - (rows * rows).sum(axis=1)))
            h = hash_strings(np.column_stack([rows, extra]), planes.value, trees, BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * trees), pa.array(h.ravel()))], names=["rep", "vec", "hashes"])

    def probe(batches):
        for b in batches:
            rows = matrix(b.column(1))
            rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
            h = hash_strings(np.column_stack([rows, np.zeros(len(rows))]), planes.value, trees, BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * trees), pa.array(h.ravel()))], names=["rep", "vec", "hashes"])

    kind = distinct.schema["vec"].dataType.simpleString()
    schema = f"rep long, vec {kind}, hashes array<long>"
    spread = lambda df: df.select("rep", "vec", F.posexplode("hashes").alias("tree", "hash"))
    hashed = materialize(map_arrow(distinct.select("rep", "vec"), index, schema), "ann-hashes")
    blocks = spark.sparkContext.broadcast(measured_blocks(hashed, n, trees, block_rows))  # two numbers a block

    def place(batches):
        for b in batches:
            h, rep = b.column(2).flatten().to_numpy().reshape(-1, trees), b.column(0).to_numpy()
            at = np.stack([blocks.value.of_rows(t, h[:, t], rep) for t in range(trees)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * trees), pa.array(at.ravel()))], names=["rep", "vec", "hashes", "blocks"])

    placed = map_arrow(hashed, place, f"{schema}, blocks array<long>")
    placed = placed.select("rep", "vec", F.posexplode(F.arrays_zip("hashes", "blocks")).alias("tree", "x"))
    forest = materialize(placed.select("tree", F.col("x.blocks").alias("block"), F.col("x.hashes").alias("hash"), "rep", "vec"), "ann-forest")

    asked = good.where(queries).select("vec_id", "vh", "vec")
    reps = distinct.select("rep", F.col("vh").alias("d_vh"), F.col("vec").alias("d_vec"))
    asked = asked.join(reps, (F.col("vh") == F.col("d_vh")) & (F.col("vec") == F.col("d_vec"))).select(F.col("vec_id").alias("query_id"), "rep")
    asked = materialize(asked, "ann-queries")
    probes = map_arrow(distinct.join(asked.select("rep").distinct(), "rep").select("rep", "vec"), probe, schema)
    probes = materialize(spread(probes).select("tree", "hash", "rep", "vec"), "ann-probes")
    found_schema = "query long, rep long, score double, cosine double"

    def scored(query: int, vec: np.ndarray, rows: np.ndarray, rep: np.ndarray, out: list) -> None:
        at, score = best_rows(vec, rows, rep, k + 1)
        out.append((np.full(len(at), query), rep[at], score, np.clip(score / (longest * math.sqrt((vec * vec).sum())), -1, 1)))

    def as_table(out: list) -> pa.Table:
        names = ["query", "rep", "score", "cosine"]
        if not out:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], names=names)

    def sorted_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, rep = rows["hash"].to_numpy(), rows["rep"].to_numpy()
        order = np.lexsort((rep, h))
        return h[order], rep[order], matrix(rows["vec"])[order]

    def descend(rows: pa.Table, probes: pa.Table) -> pa.Table:
        """Score the rows around each query's place in the sorted block."""
        out: list = []
        if rows.num_rows and probes.num_rows:
            h, rep, vec = sorted_block(rows)
            at = np.searchsorted(h, probes["hash"].to_numpy())
            for q, v, p in zip(probes["rep"].to_numpy(), matrix(probes["vec"]), at.tolist(), strict=True):
                near = slice(max(0, p - k - 1), p + k + 1)
                scored(q, v, vec[near], rep[near], out)
        return as_table(out)

    def ascend(rows: pa.Table, probes: pa.Table) -> pa.Table:
        """Score every row below each query's prefix of ``depth`` bits."""
        out: list = []
        if rows.num_rows and probes.num_rows:
            h, rep, vec = sorted_block(rows)
            shift = BITS - probes["depth"].to_numpy()
            prefix = probes["hash"].to_numpy() >> shift
            low = np.searchsorted(h, prefix << shift)
            high = np.searchsorted(h, (prefix + 1) << shift)
            asked_vec, asked_rep = matrix(probes["vec"]), probes["rep"].to_numpy()
            ranges = np.stack([low, high])
            for span in np.unique(ranges, axis=1).T:
                a, b = span.tolist()
                if a == b:
                    continue
                together = np.flatnonzero((low == a) & (high == b))
                for i in range(0, len(together), CHUNK):
                    part = together[i : i + CHUNK]
                    rough = asked_vec[part] @ vec[a:b].T  # finds the rows; the scores are summed again below
                    keep = min(k + 1, b - a)
                    cut = np.partition(rough, b - a - keep, axis=1)[:, b - a - keep]
                    slack = 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1))
                    for j, q in enumerate(part.tolist()):
                        rows_q = a + np.flatnonzero(rough[j] >= cut[j] - slack[j])
                        scored(asked_rep[q], asked_vec[q], vec[rows_q], rep[rows_q], out)
        return as_table(out)

    def locate(batches):
        for b in batches:
            tree, h, depth = (b.column(i).to_numpy() for i in range(3))
            shift = BITS - depth.astype(np.int64)
            start = (h >> shift) << shift
            end = start + (np.int64(1) << shift) - 1
            low, high = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            for t in np.unique(tree).tolist():
                at = tree == t
                low[at], high[at] = blocks.value.of_ranges(t, start[at], end[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low), pa.array(high)], names=[*b.schema.names, "low", "high"])

    def meet(probes: DataFrame, how, name: str) -> DataFrame:
        """The probes (with ``depth``) with every sub-block that their prefix touches."""
        aimed = map_arrow(probes.select("tree", "hash", "depth", "rep", "vec"), locate, f"tree int, hash long, depth int, rep long, vec {kind}, low long, high long")
        aimed = materialize(aimed, f"ann-{name}").withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")
        rows, deals = forest, F.ceil(F.col("n") / F.lit(probe_rows)).cast("int")
        crowded = aimed.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > probe_rows).select("tree", "block", deals.alias("deals")).toArrow()
        if crowded.num_rows:
            crowded = spark.createDataFrame(crowded)
            rows, aimed = (df.join(crowded, ["tree", "block"], "left").withColumn("deals", F.coalesce("deals", F.lit(1))) for df in (rows, aimed))
            rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
            aimed = aimed.withColumn("deal", F.pmod(F.xxhash64("rep"), "deals").cast("int")).drop("deals")
        else:
            rows, aimed = (df.withColumn("deal", F.lit(0)) for df in (rows, aimed))
        group = ["tree", "block", "deal"]
        return rows.groupBy(*group).cogroup(aimed.groupBy(*group)).applyInArrow(how, found_schema)

    first = materialize(meet(probes.withColumn("depth", F.lit(BITS)), descend, "aimed"), "ann-first")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    kth = first.distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k + 1).select(F.col("query").alias("rep"), "cosine")
    reach = math.log(1 - (1 - confidence) ** (1 / trees))
    agree = 1 - F.acos(F.col("cosine")) / math.pi
    depth = F.when(agree >= 1, F.lit(BITS)).when(agree > 0, F.least(F.lit(BITS), F.floor(F.lit(reach) / F.log(agree)))).otherwise(F.lit(0))
    deep = probes.join(kth, "rep", "left").withColumn("depth", F.coalesce(depth, F.lit(0)).cast("int"))
    deep = deep.where("depth > 0 OR tree = 0")  # at the root one tree holds everything
    second = meet(deep, ascend, "deep")

    top = first.unionAll(second).select("query", "rep", "score").distinct()
    top = top.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).select("query", "rep", "score")
    ids = top.join(members.select("rep", "vec_id"), "rep")
    order = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    # ids of several vectors: the best of an id's scores counts
    ids = ids.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("r", F.row_number().over(order("query"))).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    pairs = asked.join(ids, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = pairs.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_prefix_forest": op3_prefix_forest}
