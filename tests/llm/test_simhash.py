"""Operator 4 against a brute-force comparison of all fingerprints."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from attrition.llm import components, simhash
from tests.conftest import SF_SMALL


def slow_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps: dict[int, int], bits: int = 2) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op4_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    want = slow_components(fps)
    got = simhash.op4_simhash_dedup(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fps[i]:016x}", want[i]) for i in fps)


@pytest.mark.parametrize("text", [None, "", " \t", "A", "a B", "one TWO three", "x y z " * 700, "É é\x85 b c"])
def test_fingerprint_cases(text):
    assert simhash.fingerprint((text or "").encode().lower().split()) == slow_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_links_connect_everything_within_two_bits(spark, hot):
    rng = random.Random(hot)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {0, 3, (1 << 63) | 1, 1 << 63}
    for s in seeds:
        for _ in range(25):
            v = s
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    fps = {v: v for v in values}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long"), hot=hot).collect()
    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    root = {s: s for (s,) in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    got = {}
    for (s,) in signed:
        got.setdefault(find(s), set()).add(s % (1 << 64))
    want = {}
    for v, c in slow_components(fps).items():
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_nulls_copies_empty_table_and_clashing_names(spark):
    rows = [(3, None, 1), (1, "", 1), (None, "a b c d", 1), (7, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1), (9, "q r s t u", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("id", F.lit("k"))
    got = sorted(((r.id is None, r.id or 0), r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == [((False, 1), 1), ((False, 3), 1), ((False, 5), 5), ((False, 5), 5), ((False, 7), 5), ((False, 9), 9), ((True, 0), None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges_a_partition", [1 << 20, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_a_partition):
    monkeypatch.setattr(components, "EDGES", edges_a_partition)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0
