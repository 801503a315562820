"""Operator 2 against a brute-force count of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from attrition.llm import substrings
from tests.conftest import SF_SMALL


def brute(rows: list[tuple], window: int) -> list[tuple]:
    """(id, kept words, number removed) of each row, sorted."""
    first: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((-1 if i is None else i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(gone)))
    return sorted(out)


def texts(seed: int, n: int, alphabet: int) -> list[str]:
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh"[:alphabet]) for _ in range(rng.randint(6, 14))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(str(rng.randint(0, 50)) for _ in range(rng.randint(1, 9))))
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return out


@pytest.mark.parametrize(("seed", "alphabet", "group_rows"), [(1, 8, 2000), (2, 2, 1), (3, 1, 3), (4, 3, 2)])
def test_equals_brute_force(spark, seed, alphabet, group_rows):
    t = texts(seed, 60, alphabet)
    rows = [(i * 3 % 47 if i % 11 else None, x) for i, x in enumerate([*t, None, "", "a", t[0], t[0], t[3], "z " * 900, "z " * 700])]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, mark string, key int")
    got = substrings.remove_repeats(docs, window=6, gram=2, group_rows=group_rows)
    assert got.columns == ["doc_id", "text", "mark", "key", "n_words", "n_removed"]
    have = sorted((-1 if r.doc_id is None else r.doc_id, " ".join((r.text or "").split()), r.n_removed) for r in got.collect())
    assert have == brute(rows, 6)


def test_unchanged_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, " a  b "), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, window=2, gram=1).collect()}
    assert (got[1].text, got[2].text, got[3].text) == (" a  b ", None, "")
    assert [got[i].n_words for i in (1, 2, 3)] == [2, 0, 0]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_very_long_text_and_window_length(spark):
    long = " ".join(str(i) for i in range(60_000))
    docs = spark.createDataFrame([(5, long), (9, "x " + long + " y"), (10, " ".join(long.split()[:49]))], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert (got[5].n_removed, got[9].n_removed, got[9].text, got[10].n_removed) == (0, 60_000, "x y", 0)


def test_groups_of_exact_copies_stay_small(spark):
    rng = random.Random(5)
    text = " ".join(str(rng.randint(0, 10**6)) for _ in range(30))
    rows = [(i, text) for i in range(2000)] + [(7, text)] * 500 + [(3000, "z " * 20_000), (3001, "z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slim = docs.selectExpr("doc_id AS id", "xxhash64(text) & 2147483647 AS mark", "text")
    runs = substrings.dealt_runs(slim, window=6, gram=2, group_rows=50).cache()
    assert max(r["count"] for r in runs.groupBy("key", "salt").count().collect()) <= 100
    assert runs.count() == runs.select("id", "mark", "key", "lo").distinct().count()
    runs.unpersist()
    have = sorted((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(docs, window=6, gram=2, group_rows=50).collect())
    assert [(i, n) for i, _, n in have] == [(i, n) for i, _, n in brute(rows, 6)]
    assert all(" ".join(t.split()) == w for (_, t, _), (_, w, _) in zip(have, brute(rows, 6), strict=True))


def test_words_of_long_texts_are_joined_alike(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(rng.choice(list("ab é\n\t\x0b\x1c\x85"), rng.integers(0, 30))).encode()
        keep = rng.random(substrings.word_count(text)) < 0.6
        want = substrings.joined(text), substrings.joined(text, keep), substrings.word_count(text)
        with monkeypatch.context() as m:
            m.setattr(substrings, "PIECE_BYTES", -1)
            assert (substrings.joined(text), substrings.joined(text, keep), substrings.word_count(text)) == want


def test_prefixes_grow_until_their_groups_fit(spark):
    rng = random.Random(6)
    word = lambda: str(rng.randint(0, 10**6))
    # one phrase in passages that differ around it: only a longer prefix parts them
    rows = [(i, " ".join([*(word() for _ in range(7)), "p", "q", *(word() for _ in range(7))])) for i in range(800)]
    rows += [(1000 + i, t) for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slim = docs.selectExpr("doc_id AS id", "xxhash64(text) & 2147483647 AS mark", "text")
    runs = substrings.dealt_runs(slim, window=8, gram=2, group_rows=20).collect()
    sizes = {}
    for r in runs:
        sizes[r.key] = sizes.get(r.key, 0) + 1
    assert max(sizes.values()) <= 20 and {r.salts for r in runs} == {1}
    have = sorted((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(docs, window=8, gram=2, group_rows=20).collect())
    assert have == brute(rows, 8)


def test_repeated_passages_are_the_longest(spark):
    a = " ".join(f"a{i}" for i in range(70))
    b = " ".join(f"b{i}" for i in range(55))
    docs = [(1, a), (2, f"x {a}\ty {b}"), (3, f"{b} z {a} {a}"), (4, None), (None, a), (3, b)]
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.id, r.start, r.n_words, r.passage) for r in got) == [(2, 1, 70, a), (3, 0, 55, b), (3, 0, 55, b), (3, 56, 140, f"{a} {a}")]


def test_subtree_orders_suffixes_and_counts_common_words():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 3, (200, 5)).astype(np.uint32)
    order, common = substrings.subtree(s)
    rows = [tuple(r) for r in s[order].tolist()]
    assert rows == sorted(rows)
    for i in range(1, len(rows)):
        k = next((j for j in range(5) if rows[i][j] != rows[i - 1][j]), 5)
        assert common[i] == k


def test_op2_equals_brute_force_and_sql(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    import hashlib

    want = sorted((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, t, n in brute(rows, 50))
    got = substrings.op2_substring_dedup(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(n for _, n, _ in want) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    sql = con.sql(substrings.ORACLE_SQL["op2_substring_dedup"])
    assert sorted(sql.columns) == sorted(got[0].asDict())
    pick = [sql.columns.index(c) for c in ("doc_id", "n_removed", "kept_sha256")]
    assert sorted(tuple(r[i] for i in pick) for r in sql.fetchall()) == want
