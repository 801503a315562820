"""Operator 12 against all stretches by definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from attrition.llm import runs
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list, min_length: int = 6, min_exponent: float = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(min_length, min_exponent * q):
                stretch = words[s:e]
                if not any(all(a == b for a, b in zip(stretch, stretch[p:], strict=False)) for p in range(1, q)):
                    out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(documents: list[list], min_length: int = 6, min_exponent: float = 4) -> list[list[tuple[int, int, int]]]:
    index: dict = {}
    codes = np.array([index.setdefault(w, len(index)) for d in documents for w in d], np.int64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    got = runs.find(codes, first, min_length, min_exponent)
    out = []
    for k in range(len(documents)):
        s = got.of(k)
        out.append(list(zip(got.start[s].tolist(), got.length[s].tolist(), got.period[s].tolist(), strict=True)))
    return out


def documents(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    made: list[list[int]] = [[], [0], [0] * 40, [0, 1] * 30, ([0] * 5 + [1]) * 7, [*([0, 0, 1] * 9), *([0, 1] * 9)]]
    for _ in range(60):
        d: list[int] = []
        for _ in range(rng.randint(0, 6)):
            block = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 7))]
            d += block * rng.choice([1, 1, 2, 4, 5]) + block[: rng.randint(0, len(block))]
        made.append(d)
    rng.shuffle(made)
    return made


@pytest.mark.parametrize(("seed", "least", "exponent"), [(1, 6, 4), (2, 6, 4), (3, 2, 2), (4, 2, 2.5), (5, 8, 3), (6, 1, 3.3)])
def test_equals_definition(seed, least, exponent):
    docs = documents(seed)
    assert found(docs, least, exponent) == [brute(d, least, exponent) for d in docs]


def test_words_of_structure():
    fib, thue = [0], [0]
    a, b = [0, 1], [0]
    for _ in range(9):
        a, b = a + b, a
    fib = a
    for _ in range(7):
        thue = thue + [1 - x for x in thue]
    for d in (fib, thue, fib[::-1]):
        for exponent in (2, 3):
            assert found([d], 2, exponent) == [brute(d, 2, exponent)]


def test_arrays_by_definition():
    rng = np.random.default_rng(0)
    sizes = [0, 7, 0, 50, 1, 30]
    first = np.concatenate([[0], np.cumsum(sizes)])
    codes = rng.integers(0, 2, first[-1])
    sa, isa, rounds = runs.suffix_array(codes, first)
    end = np.repeat(first[1:], sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    suffix = [(doc[i], codes[i : end[i]].tolist()) for i in range(len(codes))]
    assert sa.tolist() == sorted(range(len(codes)), key=lambda i: suffix[i])
    assert isa[sa].tolist() == list(range(len(codes)))
    lcp = runs.common_prefixes(sa, first, rounds)
    for k in range(1, len(sa)):
        (d, x), (c, y) = suffix[sa[k - 1]], suffix[sa[k]]
        want = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y))) if c == d else 0
        assert lcp[k] == want
    values = rng.integers(0, 9, 300).astype(np.int32)
    for strict in (True, False):
        got = runs.nearest_before(values, np.arange(300), strict)
        for i in range(300):
            want = [j for j in range(i) if (values[j] < values[i] if strict else values[j] <= values[i])]
            assert got[i] == (want[-1] if want else -1)


def test_very_long_texts():
    n = 200_000
    assert found([[0] * n, [0, 1, 2] * (n // 3), list(range(n))]) == [[(0, n, 1)], [(0, n // 3 * 3, 3)], []]


def test_exponent_below_two_is_refused():
    with pytest.raises(ValueError):
        runs.find(np.zeros(3, np.int64), np.array([0, 3]), 1, 1.5)


def test_tables(spark):
    rows = [(1, "x y x y x y x y z", "a", 1), (1, "x y x y x y x y z", "a", 1), (None, "b " * 9, "n", 2), (3, None, "k", 3), (4, "", None, 4), (5, " no\trun ", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_dropped int")
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.periodic]) for r in runs.find_runs(docs, runs_col="periodic").collect())
    assert got == [(-1, [(0, 9, 1)]), (1, [(0, 8, 2)]), (1, [(0, 8, 2)]), (3, []), (4, []), (5, [])]
    cut = runs.collapse_runs(docs.drop("n_dropped"))
    assert cut.columns == ["doc_id", "text", "runs", "n_dropped"]
    assert sorted((r.doc_id or -1, r.text, r.n_dropped) for r in cut.collect() if r.doc_id != 3) == [(-1, "b", 8), (1, "x y z", 6), (1, "x y z", 6), (4, "", 0), (5, " no\trun ", 0)]
    assert [r.text for r in cut.collect() if r.doc_id == 3] == [None]
    assert runs.find_runs(docs.limit(0), runs_col="p").count() == 0
    assert runs.run_digests(docs.limit(0)).count() == 0


def contract(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    # a word met under four times cannot lie in four periods: cut there to keep this fast
    each: list[tuple[int, int, int]] = []
    at = 0
    while at < n:
        y = at
        while y < n and words.count(words[y]) >= 4:
            y += 1
        each += [(at + s, m, q) for s, m, q in brute(words[at:y])]
        at = y + 1
    gone = {i for s, m, q in each for i in range(s + q, s + m)}
    best = min(each, key=lambda r: (-r[1], r[0], r[2])) if each else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(each),
        *best,
        1000 * best[1] // best[2] if each else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in each)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_op12_equals_definition(spark):
    docs = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in runs.op12_periodic_runs(spark, SF_SMALL).collect()}
    want = [contract(r.doc_id, r.text) for r in docs]
    assert [got[w[0]] for w in want] == want
    assert sum(w[1] for w in want) > 10


def test_contract_on_odd_rows(spark):
    rows = [(i, "a b c " * 20) for i in range(40)] + [(50, None), (51, ""), (52, "é " * 30), (53, "x"), (None, "q " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in runs.run_digests(docs, runs.planted).collect()), key=str)
    assert got == sorted((contract(*r) for r in rows), key=str)
