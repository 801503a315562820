"""Operator 8 against greedy filling over every capacity."""

from __future__ import annotations

import random
import zlib

import pytest

from attrition.llm import sharding
from tests.conftest import SF_SMALL


def greedy(sizes, capacity):
    runs, held = 1, 0
    cuts, total = [], 0
    for s in sizes:
        if held + s > capacity:
            runs, held = runs + 1, 0
            cuts.append(total)
        held += s
        total += s
    return runs, cuts


def smallest_capacity(sizes, shards):
    c = max(max(sizes), -(-sum(sizes) // shards))
    while greedy(sizes, c)[0] > shards:
        c += 1
    return c


@pytest.mark.parametrize(("seed", "cells"), [(1, 4), (2, 16), (3, 1 << 15), (4, 7)])
def test_capacity_is_the_smallest_feasible(spark, seed, cells):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 9, 50, 400, 9000 if seed == 4 else 77]) for _ in range(rng.randint(30, 300))]
    shards = rng.randint(2, 24)
    df = spark.createDataFrame([(i - 150, s) for i, s in enumerate(sizes)], "key long, bytes long")
    capacity, cuts = sharding.minimax_cuts(sharding.running_totals(df).cache(), shards, cells)
    assert capacity == smallest_capacity(sizes, shards)
    want = greedy(sizes, capacity)[1]
    assert cuts[: len(want)] == want and all(c == sum(sizes) for c in cuts[len(want) :])


def check(rows, got, shards):
    """Copies together, slots gapless, sizes and checksums right, largest shard minimal for the order used."""
    want = sorted(((-1 if i is None else i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.id is None else r.id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_op8_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sharding.shard_documents(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, got, 24)
    from pyspark.sql import functions as F

    groups = docs.groupBy(F.xxhash64("text").alias("k")).agg(F.sum(F.octet_length("text") + 8).alias("b")).orderBy("k").collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) == smallest_capacity([g.b for g in groups], 24)
    q = sharding.op8_minimax_shards(spark, SF_SMALL)
    assert [f.simpleString() for f in q.schema] == [
        "doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int",
    ]
    assert {(r.law, r.grown_shard) for r in q.collect()} == {("bytes", None)}


def test_copies_nulls_long_texts_and_clashing_names(spark):
    texts = [None, "", "same", "same", "é" * 50_000, "x"]
    rows = [(i if i % 13 else None, texts[i % 6]) for i in range(90)] + [(2, "same")] * 30
    docs = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, shard int")
    check(rows, sharding.shard_documents(docs, shards=5).collect(), 5)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    one = sharding.shard_documents(docs.limit(1)).collect()
    assert (one[0].shard, one[0].slot) == (0, 0)
