"""Operator 2: removal of word passages that an earlier document already holds.

A suffix here is a word position of a document with at least ``window`` words
after it; a passage is repeated when two suffixes share their first ``window``
words, i.e. meet in a suffix-tree node of that depth.

1. *Prefixes.* Each suffix belongs to the prefix that ends with the least
   ``gram``-word hash among its first ``window`` words. The prefix length thus
   varies with the text (``gram`` to ``window`` words), equal passages always
   have equal prefixes' ends, and neighbouring suffixes mostly share one, so a
   run of them travels as one row. A prefix end that occurs in one document only
   cannot lie on a repeat; an aggregate (with map-side combine) drops those.
2. *Growth.* Suffixes of a prefix with more than ``group_rows`` runs get a longer
   one: the documents are read again, and of these suffixes alone the prefix ends
   with the least hash of twice, then of ``GROWTH`` times as many words. So a common
   phrase in many different passages parts into groups that fit a task. At most
   ``HOT_KEYS`` prefixes grow at a time (by their share of all runs); these are all
   that the driver reads.
3. *Groups.* The words under the runs are cut out of the texts and grouped by
   prefix. Passages that are equal, as in copies of one text, stay together however
   long the prefix; such a prefix is dealt over as many salted groups as its count
   needs. The salt is a hash of the run (id, text mark, prefix and place), so copies
   of one text and the runs of one text are dealt out as well, and rows that repeat id
   and text are cut out once: a group has about ``group_rows`` runs, whatever the
   texts. Runs of such prefixes are dealt over ``DEALS`` parts before they meet the
   count.
4. *Subtrees.* A task orders the suffixes of whole groups and takes the common
   prefix of neighbours: the leaves and inner nodes of the group's subtree.
   Nodes of depth ``window`` are the repeats; every suffix below one whose
   document is not the node's smallest is marked. In salted groups the
   smallest of each node goes on to an aggregate over the node's words, which
   joins the groups of one prefix again; it sees at most one id for each node
   and group.
5. Marks are collected by document and cut out of the text. ``repeated_passages`` gives
   them as the longest passages of each document that are covered throughout.

The order within a group goes to the first ``window`` words: which of the nodes below
that depth a suffix lies in does not change what is covered.

A long text is held whole by a task, with some 50 bytes a word beside it.

Defined results: null text has no words; words are kept unchanged; a document
without marks keeps its text as it was. A null id is neither smaller nor larger
than another, so such rows neither lose nor claim words. Rows of one id do not
make each other repeat; they are told apart by a hash of their text. Documents
shorter than the window never lose words. Other columns pass through, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import PIECE_BYTES, SPACE_BYTES, by_bytes, expand, gram_hashes, map_arrow, materialize, mix64, split_words, table, text_buffer
from attrition.operators.prefilter import members

WINDOW = 50
GRAM = 8
GROWTH = 3
RUN = 64
GROUP_ROWS = 2000
HOT_KEYS = 1 << 20
DEALS = 256
BATCH_BYTES = 1 << 20
SUBTREE_SUFFIXES = 100_000


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def prefix_ends(hashes: np.ndarray, window: int, gram: int, level: int) -> np.ndarray:
    """The prefix end of each window: its least hash of ``level + 1`` times ``gram`` words."""
    least = sliding_min(gram_hashes(hashes, gram * (level + 1)), window - gram * (level + 1) + 1)
    return mix64(least + np.uint64(level)) if level else least


def suffix_runs(first: np.ndarray, hashes: np.ndarray, window: int, gram: int, grown: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """(document, prefix end, first suffix, last suffix) for runs of suffixes
    with the same prefix end; suffixes are word numbers inside the document.
    ``grown``: sorted prefix ends of each level whose suffixes get a longer one;
    only these suffixes are returned."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    at = expand(first[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    for level, ends in enumerate(grown):
        if len(at):
            pick = np.isin(prefix_ends(hashes, window, gram, level)[at], ends, kind="sort")
            at, doc = at[pick], doc[pick]
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    local = at - first[doc]
    key = prefix_ends(hashes, window, gram, len(grown))[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(place % RUN == 0)
    last = np.append(head[1:], len(at)) - 1
    return doc[head], key[head], local[head], local[last]


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (word ranks of suffixes) and the number of leading words
    each has in common with the one before it (0 for the first)."""
    rows, width = suffixes.shape
    keys = np.ascontiguousarray(suffixes.astype(">u4")).view(np.dtype((np.void, 4 * width)))[:, 0]
    order = np.argsort(keys, kind="stable")
    ordered = suffixes[order]
    same = ordered[1:] == ordered[:-1]
    common = np.zeros(rows, np.int64)
    common[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, common


def _mark_schema(kind: str) -> str:
    return f"undecided boolean, key long, node long, id {kind}, mark long, lo int, hi int"


def dealt_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The runs of ``docs`` (``id``, ``mark``, ``text``) whose prefix several ids have,
    with the words under them and their group (``key``, ``salt``; ``salts``: number of
    groups of the key)."""
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.where(F.col("id").isNotNull())

    sc = docs.sparkSession.sparkContext

    def runs_of(longer):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, "text", BATCH_BYTES):
                words = split_words(*text_buffer(b.column(2)))
                doc, key, lo, hi = suffix_runs(words.first, words.hash, window, gram, tuple(x.value for x in longer))
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    names=["id", "mark", "key", "lo", "hi"],
                )

        return run

    levels = min(GROWTH, window // gram)
    runs = shared = frequent = None
    longer: list = []
    for level in range(levels):
        found = materialize(map_arrow(docs, runs_of(list(longer)), f"id {kind}, mark long, key long, lo int, hi int"), "suffix-runs")
        counts = found.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("runs")).where("a < b")
        counts = materialize(counts.select("key", "runs"), "suffix-shared")
        over = F.col("runs") > max(group_rows, found.count() // HOT_KEYS)  # at most HOT_KEYS
        frequent = counts.where(over).select("key")
        grows = np.sort(frequent.toArrow()["key"].to_numpy().view(np.uint64)) if level + 1 < levels else np.zeros(0, np.uint64)
        if len(grows):
            found = found.join(F.broadcast(frequent), "key", "left_anti")
            counts = counts.where(~over)
            longer.append(sc.broadcast(grows))
        runs = found if runs is None else runs.unionByName(found)
        shared = counts if shared is None else shared.unionByName(counts)
        if not len(grows):
            break
    # prefixes that no growth splits meet their count in DEALS parts
    hot = members(frequent, "key", frequent.count())
    part = F.pmod(F.xxhash64("id", "mark", "lo"), F.lit(DEALS)).cast("int")
    dealt = hot.flag(runs, "key", "_hot").withColumn("_deal", F.when(F.col("_hot"), part).otherwise(F.lit(0))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    salts = F.ceil(F.col("runs") / F.lit(group_rows)).cast("int")
    counted = hot.flag(shared, "key", "_hot").select("key", salts.alias("salts"), F.explode(every).alias("_deal"))
    wanted = dealt.join(counted, ["key", "_deal"])
    salt = F.pmod(F.xxhash64("id", "mark", "key", "lo"), F.col("salts")).cast("int")
    # a set: rows that repeat id and text have the same runs
    wanted = wanted.groupBy("id", "mark").agg(F.collect_set(F.struct("key", "lo", "hi", "salts", salt.alias("salt"))).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            words = split_words(*text_buffer(b.column(2)))
            lists = b.column(3)
            flat = lists.flatten()
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            s = words.start[words.first[doc] + lo]
            e = words.end[words.first[doc] + hi + window - 1]
            data = words.data.tobytes()
            pick = pa.array(doc)
            texts = pa.array([data[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [flat.field(0), flat.field(4), flat.field(3), b.column(0).take(pick), b.column(1).take(pick), pa.array(lo.astype(np.int32)), texts],
                names=["key", "salt", "salts", "id", "mark", "lo", "words"],
            )

    # one row of each id and text; the join has dealt and sorted them that way already
    with_runs = docs.join(wanted, ["id", "mark"]).groupBy("id", "mark").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    return map_arrow(with_runs, cut_out, f"key long, salt int, salts int, id {kind}, mark long, lo int, words binary")


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Marked suffixes of ``docs`` (``id``, ``mark``: hash of the text, ``text``) as
    rows (``id, mark, lo, hi``): the words from ``lo`` to ``hi + window - 1`` are
    covered by passages that a document of smaller id also holds."""
    kind = docs.schema["id"].dataType.simpleString()
    grouped = dealt_runs(docs, window, gram, group_rows).repartition("key", "salt").sortWithinPartitions("key", "salt")

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        texts = t["words"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        words = split_words(np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0])
        n = np.diff(words.first) - window + 1
        row = np.repeat(np.arange(len(n)), n)
        at = expand(words.first[:-1], n)
        _, rank = np.unique(words.hash, return_inverse=True)
        suffixes = rank.astype(np.uint32)[at[:, None] + np.arange(window)]
        order, common = subtree(suffixes)
        node_start = np.flatnonzero(common < window)
        node = np.cumsum(common < window) - 1
        ids = t["id"].to_numpy()[row]
        least = np.minimum.reduceat(ids[order], node_start) if len(order) else ids
        mine = np.empty(len(order), ids.dtype)
        mine[order] = least[node]
        marked = ids > mine
        undecided = ~marked & (t["salts"].to_numpy()[row] > 1)
        lo = t["lo"].to_numpy()[row] + (at - words.first[row])
        # neighbouring marked suffixes of one run become one range
        m = np.flatnonzero(marked)
        new = np.ones(len(m), bool)
        new[1:] = (row[m[1:]] != row[m[:-1]]) | (m[1:] != m[:-1] + 1)
        starts = m[new]
        ends = m[np.append(np.flatnonzero(new)[1:], len(m)) - 1] if len(m) else m
        u = np.flatnonzero(undecided)
        name = gram_hashes(words.hash, window)[at[u]].view(np.int64) if len(u) else np.zeros(0, np.int64)
        pick = pa.array(np.concatenate([row[starts], row[u]]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(starts) + len(u)) >= len(starts)),
                t["key"].combine_chunks().take(pick),
                pa.array(np.concatenate([np.zeros(len(starts), np.int64), name])),
                t["id"].combine_chunks().take(pick),
                t["mark"].combine_chunks().take(pick),
                pa.array(np.concatenate([lo[starts], lo[u]]).astype(np.int32)),
                pa.array(np.concatenate([lo[ends], lo[u]]).astype(np.int32)),
            ],
            names=["undecided", "key", "node", "id", "mark", "lo", "hi"],
        )

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last = None
        for b in by_bytes_binary(batches, 1 << 20):
            group = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)], axis=1)
            if size >= SUBTREE_SUFFIXES * 6:
                # the held rows end with group ``last``: finish them where it ends
                cut = int((group != last).any(axis=1).argmax()) if (group != last).any() else b.num_rows
                if cut:
                    held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield build(held)
                    held, size = [], 0
                    b = b.slice(cut)
                else:
                    continue
            held.append(b)
            size += b.column(6).nbytes
            last = group[-1]
        if held:
            yield build(held)

    marks = materialize(map_arrow(grouped, subtrees, _mark_schema(kind)), "suffix-marks")
    found = marks.where("not undecided").select("id", "mark", "lo", "hi")
    rest = marks.where("undecided")
    least = rest.groupBy("key", "node").agg(F.min("id").alias("least"))
    later = rest.join(least, ["key", "node"]).where("id > least").select("id", "mark", "lo", "hi")
    return found.unionByName(later)


def by_bytes_binary(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = max(1, b.num_rows * limit // max(1, b.column(6).nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def covered(ranges: list, n: int, window: int) -> np.ndarray:
    """Flags of the ``n`` words of a text that lie under its marked suffixes."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [r["lo"] for r in ranges], 1)
    np.add.at(edge, [r["hi"] + window for r in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def joined(text: bytes, keep: np.ndarray | None = None) -> bytes:
    """Words of a text (those flagged) joined by one blank."""
    if len(text) <= PIECE_BYTES:
        words = text.split()
        return b" ".join(words if keep is None else [words[j] for j in np.flatnonzero(keep).tolist()])
    words = split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    s, e = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    if not len(s):
        return b""
    data = words.data[s[0] : e[-1]]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s - s[0]], edge[e - s[0]] = 1, -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    inside[e[:-1] - s[0]] = True  # the white space after each word but the last
    out = data[inside]
    out[np.isin(out, SPACE_BYTES)] = 32
    return out.tobytes()


def word_count(text: bytes) -> int:
    if len(text) <= PIECE_BYTES:
        return len(text.split())
    return len(split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash)


def marked_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a ``mark`` that tells rows of one id apart (31 bits, which travel with
    every run), and its columns ``id``, ``mark`` and ``text``."""
    marked = docs.withColumn("mark", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)))
    return marked, marked.select(F.col(id_col).alias("id"), "mark", F.col(text_col).alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, mark, start, n_words, passage): the longest passages of each document all of
    whose words ``remove_repeats`` would remove; ``mark`` tells rows of one id apart."""
    _, slim = marked_texts(docs.select(id_col, text_col), id_col, text_col)
    ranges = find_repeats(slim, window).groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            rows = []
            for i, (text, ranges_i) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                text = text.encode()
                n = word_count(text)
                edge = np.diff(covered(ranges_i, n, window).astype(np.int8), prepend=0, append=0)
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    keep = np.zeros(n, bool)
                    keep[x:y] = True
                    rows.append((i, x, y - x, joined(text, keep).decode()))
            pick = pa.array([r[0] for r in rows], pa.int64())
            columns = [b.column(0).take(pick), b.column(1).take(pick), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "start", "n_words", "passage"])

    with_ranges = slim.dropDuplicates(["id", "mark"]).join(ranges, ["id", "mark"])
    return map_arrow(with_ranges, run, f"id {kind}, mark long, start long, n_words long, passage string")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``docs`` with the repeated words cut from ``text_col`` and two new columns,
    ``n_words`` and ``n_removed``. Changed texts are their kept words joined by one
    blank; unchanged texts stay as they were (null too)."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    marked, slim = marked_texts(inner, ident, text)
    ranges = (
        find_repeats(slim, window, gram, group_rows)
        .groupBy("id", "mark")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
        .select(F.col("id").alias("r_id"), F.col("mark").alias("r_mark"), "ranges")
    )
    with_ranges = marked.join(ranges, (F.col(ident) == F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left")
    with_ranges = with_ranges.select(*inner.columns, "ranges")
    plain = inner.columns
    where = plain.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, 4 * BATCH_BYTES):
            old = b.column(where)
            texts = old.to_pylist()
            counts, removed = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, ranges_i in enumerate(b.column(len(names)).to_pylist()):
                whole = (texts[i] or "").encode()
                counts[i] = word_count(whole)
                if ranges_i:
                    keep = ~covered(ranges_i, int(counts[i]), window)
                    removed[i] = len(keep) - keep.sum()
                    if removed[i]:
                        texts[i] = joined(whole, keep).decode()
            columns = [b.column(c) for c in range(len(names))]
            columns[where] = pa.array(texts, old.type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts), pa.array(removed)], names=[*plain, "n_words", "n_removed"]
            )

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in inner.schema], "n_words long", "n_removed long"])
    out = map_arrow(with_ranges, cut, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_removed")


def kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words of each text joined by one blank."""
    for b in by_bytes(batches, "text", BATCH_BYTES):
        digests = [hashlib.sha256(joined((t or "").encode())).hexdigest() for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs).select("doc_id", "n_words", "n_removed", "text")
    kind = cut.schema["doc_id"].dataType.simpleString()
    return map_arrow(cut, kept_digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), earliest AS (
  SELECT passage, min(doc_id) AS first_doc FROM win GROUP BY passage HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i FROM win JOIN earliest USING (passage) WHERE doc_id > first_doc
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hit
), per AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([words[j] FOR j IN range(1, len(words) + 1) IF js IS NULL OR NOT list_contains(js, j)], ' '), '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
}
