"""Operator 13 against scores of all documents for all items, and SQL."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from attrition.llm import ranked
from tests.conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item, rank, document, score), every document scored for every item."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    df = collections.Counter(w for _, c in counts for w in c)
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    merged: dict = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in merged.items():
        rows = []
        for i, c in counts:
            score = 0
            for w in wanted:
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    norm = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                    score += weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * norm))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "日本", "x1", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = []
    for i in range(n):
        t = rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=rng.randint(0, 30)))
        made.append((i * 7 % 1001, t))
    made += [(2000 + i, made[3][1]) for i in range(80)]  # a group of copies, larger than k
    return made


@pytest.mark.parametrize(("seed", "stages", "block_docs", "bundle_terms"), [(1, 4, 1 << 15, 1 << 16), (2, 3, 10, 20), (3, 1, 50, 8), (4, 6, 25, 1 << 16)])
def test_equals_scoring_everything(spark, seed, stages, block_docs, bundle_terms):
    rows = [*corpus(seed, 400), (None, "w1 w2 x1"), (None, None), (5, ""), (5, "w7 w7 w7"), (5, "w7 w7 w7")]
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(70)] + ["the", "été", "日本"], k=rng.randint(0, 12)))) for i in range(12)]
    items += [(50, rows[3][1]), (51, None), (52, "nowhere"), (53, "w1"), (53, "w9 x1"), (None, "w5"), (54, "w2 w2 w2")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search(docs, asked, k=20, stages=stages, block_docs=block_docs, bundle_terms=bundle_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(got) == brute(rows, items, 20)


def test_accumulators_are_let_go_only_when_they_cannot_win():
    rng = np.random.default_rng(3)
    n, n_terms, k = 200, 12, 5
    parts = rng.integers(0, 1000, (n_terms, n)) * (rng.random((n_terms, n)) < 0.5)
    weight = np.sort(rng.integers(1, 50, n_terms))[::-1].astype(np.int64)
    want = (weight[:, None] * parts).sum(axis=0)
    order = np.lexsort((np.arange(n), -want))[:k]
    bundle = {
        "item_terms": np.array([0, n_terms]),
        "term": np.arange(n_terms),
        "weight": weight,
        "most": parts.max(axis=1),
        "held": np.array([0, 0]),
        "doc": np.zeros(0, np.int32),
        "score": np.zeros(0, np.int64),
    }
    kept = []
    for stage in range(4):
        mine = np.arange(3 * stage, 3 * stage + 3)
        doc, part = np.concatenate([np.flatnonzero(parts[t]) for t in mine]), np.concatenate([parts[t][parts[t] > 0] for t in mine])
        count = (parts[mine] > 0).sum(axis=1)
        after = ranked.add_contributions(bundle, mine, count, doc, part, bundle["term"] <= mine[-1], k, stage == 3)
        bundle = dict(zip(["item_terms", "term", "weight", "most", "held", "doc", "score"], after, strict=True))
        kept.append(int(bundle["held"][1]))
    assert kept[2] < n and kept[3] == k
    assert dict(zip(bundle["doc"].tolist(), bundle["score"].tolist(), strict=True)) == dict(zip(order.tolist(), want[order].tolist(), strict=True))
    assert bundle["item_terms"].tolist() == [0, 0]


def test_very_long_texts_are_counted_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(ranked, "PIECE_BYTES", 64)
    text = " ".join(random.Random(1).choice(["aa", "b" * 200, "c1", "日本"]) for _ in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = list(ranked.cut(data, np.array([0, 0, len(data)]), 64))
    assert b"".join(d.tobytes() for d, _, _ in pieces) == text.encode()
    held = ranked._Block()
    import pyarrow as pa

    held.add(pa.array([1, 2]), data, np.array([0, 0, len(data)]), np.ones(1 << ranked.SLOT_BITS, np.uint8))
    row = held.row(0)
    assert row[1].to_pylist() == [1] and row[2].to_pylist() == [500]
    assert sorted(row[-1].to_pylist()[0]) == sorted(collections.Counter(text.split()).values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs, spark.createDataFrame([(1, "zzz")], items.schema)).count() == 0
    assert [tuple(r) for r in ranked.search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")], 50)


def test_op13_equals_scoring_everything_and_sql(spark):
    import duckdb

    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/{n}.parquet").select({"documents": ["doc_id", "text"], "benchmark": ["item_id", "text"]}[n]).collect()]
    got = result(ranked.op13_ranked_search(spark, SF_SMALL))
    assert got == brute(read("documents"), read("benchmark"), 50)
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF_SMALL}/{n}.parquet'")
    assert sorted(con.sql(ranked.ORACLE_SQL["op13_ranked_search"]).fetchall(), key=str) == got
