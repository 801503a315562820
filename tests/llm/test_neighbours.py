"""Operator 3 against brute force: recall, exact scores, ties, copies, odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import neighbours


def brute(rows, k, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    ids = sorted(good)
    out = {}
    for q in ids:
        if q % every == 0:
            s = [(-float((good[i] * good[q]).sum()), i) for i in ids if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_op3_recall_and_exact_scores(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    df = neighbours.op3_prefix_forest(spark, d)
    assert [f.simpleString() for f in df.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    got = as_lists(df)
    assert set(got) == set(want)
    vec = dict(rows)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and q not in [i for i, _ in found]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            assert s == pytest.approx(float((np.array(vec[i], np.float64) * np.array(vec[q], np.float64)).sum()), abs=1e-12)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_recall_over_blocks_and_norms(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 3) + rng.standard_normal(16) * 0.4).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, v) for i, v in rows], 20)
    got = as_lists(neighbours.search(df, F.col("vec_id") % 20 == 0, block_rows=block_rows))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def test_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(70)] + [(100, [2.0, 1.0]), (120, [0.5, 0.5]), (140, [-3.0, 1.0])]
    rows += [(160, None), (180, [0.0, 0.0]), (200, [1.0, None]), (220, [nan, 1.0]), (240, [inf, 1.0]), (260, []), (280, [1.0]), (None, [1.0, 1.0])]
    rows += [(40, [1.0, 2.0])] * 3
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<double>, rep string, block int")
    got = as_lists(neighbours.search(df, F.col("vec_id") % 20 == 0))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 2], 20)
    assert got == want
    few = as_lists(neighbours.search(df.where("vec_id >= 100"), F.col("vec_id") % 20 == 0))
    assert {q: len(v) for q, v in few.items()} == {100: 2, 120: 2, 140: 2}
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df.where("vec_id = 180"), F.lit(True)).count() == 0
    assert neighbours.search(df.where("vec_id = 100"), F.lit(True)).count() == 0


def test_blocks_of_a_noisy_cluster_stay_small(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 1e-4 if i % 3 == 0 else rng.standard_normal(16)).tolist()) for i in range(1800)]
    unit = np.array([[*v, 0.0] for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    h = neighbours.hash_strings(unit, neighbours.hyperplanes(16, 4, neighbours.BITS), 4, neighbours.BITS)
    hashed = spark.createDataFrame([(x,) for x in h.tolist()], "hashes array<long>")
    blocks = neighbours.measured_blocks(hashed, len(h), 4, 20)
    for t in range(4):
        at = blocks.of_rows(t, h[:, t], np.arange(len(h)))
        assert np.bincount(at).max() <= 4 * 20  # of 600 rows with one prefix
        low, high = blocks.of_ranges(t, h[:, t], h[:, t])
        assert (low <= at).all() and (at <= high).all()
        assert blocks.of_ranges(t, np.array([0]), np.array([(1 << neighbours.BITS) - 1])) == (0, blocks.first[t][-1] - 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 5)
    got = as_lists(neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, trees=4, block_rows=100, probe_rows=10))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
