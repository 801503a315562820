"""Operator 9 against plain dictionaries of counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import lm
from tests.conftest import SF_SMALL


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def role_of(doc_id):
    if doc_id is None:
        return lm.KEPT
    crc = zlib.crc32(str(doc_id).encode())
    return lm.HELD_OUT if crc % 7 == 2 else lm.DELETED if crc // 7 % 10 == 0 else lm.KEPT


class Plain:
    def __init__(self, docs):
        self.word, self.pair, self.context = Counter(), Counter(), Counter()
        for t in docs:
            self.word.update(t)
            steps = list(zip(["<s>", *t[:-1]], t, strict=True))
            self.pair.update(steps)
            self.context.update(c for c, _ in steps)
        self.n, self.v = sum(self.word.values()), len(self.word)

    def parts(self, t):
        for c, w in zip(["<s>", *t[:-1]], t, strict=True):
            k = self.context[c]
            yield int(math.log2(k)) + 1 if k else 0, self.pair[c, w] / max(k, 1), self.word[w] / max(self.n, 1), 1 / (self.v + 1)


def plain_scores(rows):
    split = [(i, tokens(t)) for i, t in rows]
    kept = Plain([t for i, t in split if role_of(i) == lm.KEPT])
    every = Plain([t for i, t in split if role_of(i) != lm.HELD_OUT])
    cells = Counter()
    for i, t in split:
        if role_of(i) == lm.DELETED:
            for b, p2, p1, _ in kept.parts(t):
                cells[b, lm.ungrid(int(lm.grid(np.array(p2)))), lm.ungrid(int(lm.grid(np.array(p1))))] += 1
    w = lm.learn_weights([(*k, n) for k, n in cells.items()], 1 / (kept.v + 1), every.n > 0)
    out = []
    for i, t in split:
        score = sum(math.log10(w[b] @ [p2, p1, p0]) for b, p2, p1, p0 in every.parts(t))
        base = sum(math.log10((every.word[x] + 1) / (every.n + every.v + 1)) for x in t)
        out.append((-1 if i is None else i, role_of(i) == lm.HELD_OUT, len(t), sum(every.word[x] > 0 for x in t), every.n, base, score))
    return sorted(out, key=repr)


def check(got, want):
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def as_query(model):
    return lm.score(model).select(F.col("id").alias("doc_id"), (F.col("role") == lm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.totals.tokens).alias("train_tokens"), "base_score", "score").collect()


def test_op9_equals_plain_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = lm.op9_deleted_interpolation(spark, SF_SMALL).collect()
    check(got, plain_scores(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_slices_ranges_nulls_and_repeats_change_nothing(spark):
    base = [None, "", " ", "A b a B c", "a b", "a a a a " * 500, "é É x", "q\x0br s\x85t"]
    rows = [(i % 30 if i != 5 else None, base[i * i % len(base)]) for i in range(60)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, slice string, range int")
    check(as_query(lm.train(docs, lm.split_role(), slice_bytes=40)), plain_scores(rows))


def test_nothing_to_learn_and_empty_table(spark):
    only = [i for i in range(200) if role_of(i) == lm.HELD_OUT][:4]
    rows = [(i, "x y") for i in only]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string"), lm.split_role())
    check(as_query(model), plain_scores(rows))
    empty = lm.train(spark.createDataFrame([], "doc_id long, text string"), lm.split_role())
    assert as_query(empty) == []


def test_estimates_sum_to_one():
    docs = [tokens(t) for t in ("a b c", "a b", "c a a")]
    p = Plain(docs)
    w = lm.learn_weights([(1, 0.5, 0.1, 3)], 0.1, True)
    for context in [*p.word, "<s>"]:
        if p.context[context]:
            b = int(math.log2(p.context[context])) + 1
            known = sum(w[b] @ [p.pair[context, x] / p.context[context], p.word[x] / p.n, 1 / (p.v + 1)] for x in p.word)
            assert known + w[b][2] / (p.v + 1) == pytest.approx(1)


def test_pack_round_trip():
    for a in (np.array([], np.uint64), np.array([1, 2**63], np.uint64), np.arange(5, dtype=np.uint32), np.zeros(3, np.uint8)):
        b = lm.unpack(lm.pack(a))
        assert b.dtype == a.dtype and b.tolist() == a.tolist()
