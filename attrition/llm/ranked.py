"""Operator 13: ranked lexical search by pipelined term partitioning.

Documents are ranked for every item of a query table by a sum of integer term
contributions. Terms are dealt to a few *owners*; bundles of items travel through the
owners' stages one after the other and gather sparse accumulators on the way.

1. *Blocks.* A map over the documents counts the terms that the items can use (a table of
   ``2^20`` hash slots, one byte each, tells which) and packs the counts of up to
   ``BLOCK_DOCS`` documents into one row: a block. Document numbers of a block follow
   the ids. The blocks are written once; the corpus totals and each term's document
   count and largest frequency come from them.
2. *Owners.* Slots are ordered by their terms' document counts and dealt to ``stages``
   owners with about equal postings each, rare terms first. The postings, now with
   their integer weight in the document, are written by owner.
3. *Bundles.* Items go in bundles of about ``BUNDLE_TERMS`` terms. A bundle meets each block:
   its row holds the items' terms, their weights and, to begin with, no accumulators.
4. *Stages.* One after the other, the owners' postings and the bundles are brought
   together by a cogroup on (block, bundle); the contributions of the owner's terms are
   added to the accumulators, and the bundle goes on without these terms.
   An accumulator stays unless ``k`` others of its item and block are already above
   all that it can still reach with the terms to come (their largest possible
   contribution is known), so the ranking is exact. A document that was let go may come
   back with too low a score; its true score is below the ``k`` best, so it can't enter.
5. *Selection.* A block's ``k`` best of each item go to a ranked window (cut to ``k`` rows
   before its shuffle as well).

A hot term is a posting list in every block, none longer than the block; a bundle is
bounded by its terms and by the block's documents for each item. Sent to the driver and
broadcast: one byte for each of the ``2^20`` slots, and two totals. Terms are compared
by 64-bit hashes.

Defined results: null text has no terms; an item without terms, or whose terms no
document has, has no rows. Rows that repeat an item's id are one item with the terms
of all of them. Documents that repeat an id are ranked each; a null id comes last
among equal scores. Only the id and text columns are read. An empty table on either
side gives an empty result. Texts over ``PIECE_BYTES`` are counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, map_arrow, materialize, split_words, table, text_buffer

TOP = 50
STAGES = 4
BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 2_000_000
BUNDLE_TERMS = 1 << 16
BUNDLE_BLOCKS = 256
SLOT_BITS = 20
PIECE_BYTES = 2 << 20
SCALE = 1_000_000_000

#: Bytes outside the term rule ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
BETWEEN_TERMS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

_IN_TERM = np.ones(256, bool)
_IN_TERM[BETWEEN_TERMS] = False


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def cut(data: np.ndarray, off: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document of each part) of a batch's texts, about ``limit`` bytes at
    a time; longer texts are parted where no term goes on."""
    limit = limit or PIECE_BYTES
    parts, owner = [0], []
    for k in range(len(off) - 1):
        at, end = int(off[k]), int(off[k + 1])
        while end - at > limit:
            stop = at + limit
            while stop < end:
                outside = np.flatnonzero(~_IN_TERM[data[stop : min(end, stop + limit)]])
                if len(outside):
                    stop += int(outside[0])
                    break
                stop = min(end, stop + limit)
            parts.append(stop)
            owner.append(k)
            at = stop
        parts.append(end)
        owner.append(k)
    edge, of = np.array(parts, np.int64), np.array(owner, np.int64)
    i = 0
    while i < len(of):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + limit, side="right")) - 1)
        yield data[edge[i] : edge[j]], edge[i : j + 1] - edge[i], of[i:j]
        i = j


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct term hashes of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", PIECE_BYTES):
            for data, off, of in cut(*text_buffer(b.column(1))):
                words = split_words(data, off, lower=True, inside=_IN_TERM)
                doc = np.repeat(of, np.diff(words.first))
                pairs = np.unique(np.stack([doc.astype(np.uint64), words.hash]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["item", "term"])

    picked = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["item"].dataType.simpleString()
    return map_arrow(picked, run, f"item {kind}, term long").distinct()


class _Block:
    """Counts of one block while its documents come in."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.postings = 0

    def add(self, ids: pa.Array, data: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> None:
        sizes = np.zeros(len(ids), np.int64)
        for piece, edge, of in cut(data, off):
            words = split_words(piece, edge, lower=True, inside=_IN_TERM)
            doc = np.repeat(of, np.diff(words.first))
            np.add.at(sizes, of, np.diff(words.first))
            pick = wanted[slot_of(words.hash)] != 0
            part = merged(words.hash[pick], self.docs + doc[pick], np.ones(int(pick.sum()), np.int64))
            self.parts.append(part)
            self.postings += len(part[0])
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.docs += len(ids)

    def row(self, number: int) -> list[pa.Array]:
        ids = pa.concat_arrays(self.ids)
        sizes = np.concatenate(self.sizes)
        term, doc, tf = merged(*(np.concatenate([p[c] for p in self.parts]) for c in range(3)))
        place = np.empty(len(ids), np.int64)
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
        held = np.zeros(len(ids), bool)
        held[doc] = True
        order = order[held[order]]  # documents with postings, by id
        place[order] = np.arange(len(order))
        head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(term)))
        top = np.maximum.reduceat(tf, head) if len(head) else tf
        lists = [ids.take(pa.array(order)), sizes[order], term[head].view(np.int64), count, top, place[doc], tf]
        return [
            pa.array([number], pa.int64()),
            pa.array([int((sizes > 0).sum())], pa.int64()),
            pa.array([int(sizes.sum())], pa.int64()),
            *(one_list(x) for x in lists),
        ]


def one_list(values: np.ndarray | pa.Array) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def merged(term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by term and document, ordered so (``doc`` must ascend)."""
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    if not len(term):
        return term, doc, tf
    new = np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))
    head = np.flatnonzero(new)
    return term[head], doc[head], np.add.reduceat(tf, head)


_BLOCK_NAMES = ["block", "n_docs", "n_terms", "ids", "sizes", "term", "count", "top", "doc", "tf"]


def term_blocks(docs: DataFrame, wanted: np.ndarray, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of ``docs`` (``id``, ``text``): counts of the terms of wanted slots."""
    kind = docs.schema["id"].dataType.simpleString()
    flags = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.frombuffer(flags.value, np.uint8)
        number = TaskContext.get().partitionId() << 32
        held = _Block()
        for b in by_bytes(batches, "text", PIECE_BYTES):
            held.add(b.column(0), *text_buffer(b.column(1)), slots)
            if held.docs >= block_docs or held.postings >= BLOCK_POSTINGS:
                yield pa.RecordBatch.from_arrays(held.row(number), names=_BLOCK_NAMES)
                number, held = number + 1, _Block()
        if held.docs:
            yield pa.RecordBatch.from_arrays(held.row(number), names=_BLOCK_NAMES)

    lists = f"ids array<{kind}>, sizes array<long>, term array<long>, count array<long>, top array<long>, doc array<long>, tf array<long>"
    return map_arrow(docs, run, f"block long, n_docs long, n_terms long, {lists}")


def owners_of_slots(weighted: DataFrame, stages: int) -> np.ndarray:
    """Owner of each slot (255: no term of an item), rare terms first and about equal
    postings each. At most ``2^20`` rows come to the driver."""
    slot = F.shiftrightunsigned("term", 64 - SLOT_BITS)
    per_term = weighted.groupBy("term").agg(F.max("df").alias("df"))
    rows = per_term.groupBy(slot.alias("slot")).agg(F.max("df").alias("most"), F.sum("df").alias("postings")).toArrow()
    owner = np.full(1 << SLOT_BITS, 255, np.uint8)
    slots, most, postings = (rows[c].to_numpy() for c in ("slot", "most", "postings"))
    order = np.lexsort((slots, most))
    before = np.cumsum(postings[order]) - postings[order]
    owner[slots[order]] = before * stages // max(1, int(postings.sum()))
    return owner


def owner_postings(blocks: DataFrame, owner: np.ndarray, docs: int, terms: int) -> DataFrame:
    """(owner, block, term, count, doc, part): each owner's posting lists of each block;
    ``part`` is a term's weight in the document, before the term's own weight."""
    owners = blocks.sparkSession.sparkContext.broadcast(owner.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slot = np.frombuffer(owners.value, np.uint8)
        for b in batches:
            for i in range(b.num_rows):
                sizes, term, count, doc, tf = (b.column(c)[i].values.to_numpy() for c in range(1, 6))
                mine = of_slot[slot_of(term)]
                spread = np.repeat(mine, count)
                norm = 100 - 50 + (50 * sizes * docs) // terms
                part = (SCALE * tf) // (1000 * tf + 20 * norm[doc])
                for o in np.unique(mine[mine != 255]).tolist():
                    lists = [term[mine == o], count[mine == o], doc[spread == o].astype(np.int32), part[spread == o].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o], pa.int32()), b.column(0).slice(i, 1), *(one_list(x) for x in lists)], names=["owner", "block", "term", "count", "doc", "part"]
                    )

    picked = blocks.select("block", "sizes", "term", "count", "doc", "tf")
    return map_arrow(picked, run, "owner int, block long, term array<long>, count array<long>, doc array<int>, part array<int>")


_STATE = ["item", "item_terms", "term", "weight", "most", "held", "doc", "score"]


def _state_schema(kind: str) -> str:
    return f"item array<{kind}>, item_terms array<int>, term array<long>, weight array<long>, most array<long>, held array<int>, doc array<int>, score array<long>"


def bundle_rows(weighted: DataFrame, bundles: int) -> DataFrame:
    """One row a bundle: its items, and their terms in a row (``item_terms`` of each
    item), with weight and largest contribution; no accumulators yet (``held`` of each
    item, ``doc``, ``score``)."""
    per_item = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight", "most")).alias("terms"))
    number = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int")
    grouped = per_item.groupBy(number.alias("bundle")).agg(F.collect_list(F.struct("item", "terms")).alias("items"))
    flat = lambda c: F.flatten(F.transform("items", lambda x: x["terms"][c]))
    return grouped.select(
        "bundle",
        F.col("items.item").alias("item"),
        F.transform("items", lambda x: F.size(x["terms"])).alias("item_terms"),
        flat("term").alias("term"),
        flat("weight").alias("weight"),
        flat("most").alias("most"),
        F.transform("items", lambda x: F.lit(0)).alias("held"),
        F.array().cast("array<int>").alias("doc"),
        F.array().cast("array<long>").alias("score"),
    )


def add_contributions(bundle: dict[str, np.ndarray], term: np.ndarray, count: np.ndarray, doc: np.ndarray, part: np.ndarray, past: np.ndarray, k: int, last: bool) -> list[np.ndarray]:
    """The bundle's columns after an owner: posting lists (``term`` ascending as unsigned,
    ``count`` each) are added to the accumulators, the terms ``past`` (of owners so far) are
    left behind. After the last owner only the ``k`` best of each item stay."""
    start = np.cumsum(count) - count
    width = int(max(doc.max(initial=-1), bundle["doc"].max(initial=-1))) + 1
    n_terms, n_held = bundle["item_terms"], bundle["held"]
    t_end, h_end = np.cumsum(n_terms), np.cumsum(n_held)
    place = np.searchsorted(term.view(np.uint64), bundle["term"].view(np.uint64))
    place[place == len(term)] = 0
    here = (term[place] == bundle["term"]) if len(term) else np.zeros(len(place), bool)
    rest = np.where(past, 0, bundle["weight"] * bundle["most"])
    held, docs, scores = np.zeros(len(n_terms), np.int32), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    total = np.zeros(width, np.int64)
    for i in range(len(n_terms)):
        mine = slice(t_end[i] - n_terms[i], t_end[i])
        own = slice(h_end[i] - n_held[i], h_end[i])
        total[:] = 0
        total[bundle["doc"][own]] = bundle["score"][own]
        for t in np.flatnonzero(here[mine]).tolist():
            x = start[place[mine][t]]
            y = x + count[place[mine][t]]
            total[doc[x:y]] += bundle["weight"][mine][t] * part[x:y].astype(np.int64)
        at = np.flatnonzero(total)
        score = total[at]
        if len(at) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            stay = score + int(rest[mine].sum()) >= least
            at, score = at[stay], score[stay]
        if last and len(at) > k:
            best = np.lexsort((at, -score))[:k]
            at, score = at[best], score[best]
        held[i] = len(at)
        docs.append(at.astype(np.int32))
        scores.append(score)
    stay = ~past
    left = np.add.reduceat(np.append(stay, False).astype(np.int32), t_end - n_terms) if len(n_terms) else n_terms
    left = np.where(n_terms > 0, left, 0).astype(np.int32)
    return [left, bundle["term"][stay], bundle["weight"][stay], bundle["most"][stay], held, np.concatenate(docs), np.concatenate(scores)]


def owner_stage(bundles: DataFrame, postings: DataFrame, owner: np.ndarray, stage: int, k: int, last: bool) -> DataFrame:
    """Bundles after the stage of one owner."""
    sc = bundles.sparkSession.sparkContext
    owners = sc.broadcast(owner.tobytes())
    kind = bundles.schema["item"].dataType.elementType.simpleString()

    def meet(_key, lists: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:  # postings that no bundle asks for
            return state
        of_slot = np.frombuffer(owners.value, np.uint8)
        columns = {c: state[c].combine_chunks() for c in state.column_names}
        bundle = {c: columns[c][0].values.to_numpy(zero_copy_only=False) for c in _STATE[1:]}
        flat = {c: lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if lists.num_rows else np.zeros(0, np.int64) for c in ("term", "count", "doc", "part")}
        past = of_slot[slot_of(bundle["term"])] <= stage
        after = add_contributions(bundle, flat["term"], flat["count"], flat["doc"], flat["part"], past, k, last)
        return pa.Table.from_arrays(
            [columns["block"], columns["bundle"], columns["item"], *(one_list(x) for x in after)], names=["block", "bundle", *_STATE]
        ).cast(state.schema)

    left = postings.where(F.col("owner") == stage).drop("owner").groupBy("block", "bundle")
    return left.cogroup(bundles.groupBy("block", "bundle")).applyInArrow(meet, f"block long, bundle int, {_state_schema(kind)}")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    stages: int = STAGES,
    block_docs: int = BLOCK_DOCS,
    bundle_terms: int = BUNDLE_TERMS,
) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` best documents of each item with
    a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_kind, item_kind = plain.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    queries = materialize(item_terms(items, item_col, item_text_col), "ranked-items")
    slots = queries.select(F.shiftrightunsigned("term", 64 - SLOT_BITS).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    wanted = np.zeros(1 << SLOT_BITS, np.uint8)
    wanted[slots] = 1
    blocks = materialize(term_blocks(plain, wanted, block_docs), "ranked-blocks")
    totals = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("blocks")).first()
    nothing = spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {id_kind}, score long")
    if not totals.docs:
        return nothing

    each = blocks.select(F.inline(F.arrays_zip("term", "count", "top")))
    counted = each.groupBy("term").agg(F.sum("count").alias("df"), F.max("top").alias("top"))
    weight = F.floor(1000 * F.log(F.lit(2 * totals.docs + 2) / (2 * F.col("df") + 1)))
    most = F.expr(f"({SCALE} * top) div (1000 * top + 1000)")  # the shortest possible document
    weighted = queries.join(counted, "term").select("item", "term", "df", weight.cast("long").alias("weight"), most.alias("most"))
    weighted = materialize(weighted.where("weight > 0"), "ranked-terms")
    owner = owners_of_slots(weighted, stages)
    n_bundles = max(1, -(-weighted.count() // bundle_terms))

    postings = materialize(owner_postings(blocks, owner, totals.docs, totals.terms), "ranked-postings", partition_by="owner")
    postings = postings.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))))
    # each bundle in copies, so that a copy meets a bounded number of blocks
    copies = -(-totals.blocks // BUNDLE_BLOCKS)
    dealt = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"))
    copied = materialize(bundle_rows(weighted, n_bundles), "ranked-bundles").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    state = dealt.join(copied, ["bundle", "copy"]).select("block", "bundle", *_STATE)
    for stage in range(stages):
        state = owner_stage(state, postings, owner, stage, k, stage == stages - 1)

    def name_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                item, ids = b.column(0)[i].values, b.column(4)[i].values
                held, doc, score = (b.column(c)[i].values for c in (1, 2, 3))
                rows = pa.array(np.repeat(np.arange(len(held)), held.to_numpy()))
                yield pa.RecordBatch.from_arrays([item.take(rows), ids.take(doc), score], names=["item", "id", "score"])

    met = state.select("block", "item", "held", "doc", "score").join(blocks.select("block", "ids"), "block").drop("block")
    candidates = map_arrow(met, name_documents, f"item {item_kind}, id {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranked_search": op13_ranked_search}

ORACLE_SQL = {
    "op13_ranked_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
), size AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM size
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
}
