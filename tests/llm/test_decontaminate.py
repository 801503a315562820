"""Operator 7 against all alignments of all items with all documents."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from attrition.llm import decontaminate as dec
from tests.conftest import SF_SMALL

PUNCTUATION = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(rf"[^\x20\x09-\x0D{PUNCTUATION}]+", low)


def brute(docs, items):
    """(doc, item, equal, length, item_from, doc_from): the best overlap of each pair."""
    out = []
    for d, text in docs:
        w = tokens(text)
        for item, item_text in items:
            t = tokens(item_text)
            n = len(t)
            if n < dec.MIN_LENGTH:  # the whole item, 4 of 5 tokens equal
                places = [(sum(x == y for x, y in zip(w[p : p + n], t)), -p) for p in range(len(w) - n + 1)]
                if n and places and 5 * max(places)[0] >= 4 * n:
                    out.append((d, item, max(places)[0], n, 0, -max(places)[1]))
                continue
            best = None
            for shift in range(-len(t) + dec.SPAN, len(w) - dec.SPAN + 1):
                lo, hi = max(0, -shift), min(len(t), len(w) - shift)
                eq = [t[j] == w[shift + j] for j in range(lo, hi)]
                if sum(eq) < min(dec.MIN_EQUAL, len(t)):
                    continue
                for a in range(len(eq) - dec.SPAN + 1):
                    if sum(eq[a : a + dec.SPAN]) < dec.SPAN - 2:
                        continue
                    spans = [
                        (y - x, x, y)
                        for x in range(len(eq))
                        for y in range(x + 1, len(eq) + 1)
                        if eq[x] and eq[y - 1] and min(x, a) >= 0 and x <= a + dec.SPAN - 1 and y >= a + 1
                        and (x <= a or not any(eq[a:x])) and (y >= a + dec.SPAN or not any(eq[y : a + dec.SPAN]))
                        and 5 * sum(eq[x:y]) >= 4 * (y - x)
                    ]
                    if not spans:
                        continue
                    length = max(s[0] for s in spans)
                    x = min(s[1] for s in spans if s[0] == length)
                    same = sum(eq[x : x + length])
                    if same >= min(dec.MIN_EQUAL, len(t)) and length >= min(dec.MIN_LENGTH, len(t)):
                        key = (same, -(shift + lo + x))
                        if best is None or key > best[0]:
                            best = (key, (d, item, same, length, lo + x, shift + lo + x))
            if best:
                out.append(best[1])
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.id, r.item, r.equal, r.length, r.item_from, r.doc_from) for r in df.collect()), key=repr)


def test_masks_find_any_two_substitutions():
    assert len(dec.MASKS) == 10 and all(len(m) == 6 for m in dec.MASKS)
    for pair in combinations(range(dec.SPAN), 2):
        assert any(not set(pair) & set(m) for m in dec.MASKS)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_substitutions(spark, seed, monkeypatch):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 2 + seed)))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 5, 7, 9, 10, 11, 12, 14, 25])))) for i in range(14)] + [(90, None), (None, "a b c d e f g h i j k l")]
    docs = [(0, None), (1, ""), (2, "a, b! C d.e f\ng h i j k l")]
    for d in range(3, 50):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = (rng.choice(items)[1] or "").split()
            t = [word() if rng.random() < rng.choice([0, 0.1, 0.25]) else x for x in t]
            parts.append(" ".join(t[rng.randint(0, 4) :]) + rng.choice([" ", ", ", "\n"]) + " ".join(word() for _ in range(rng.randint(0, 9))))
        docs.append((d % 45, rng.choice([str.upper, str])(" ".join(parts))))
    frame = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, item string, equal int")
    bench = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, id string")
    want = brute(docs, items)
    assert len(want) > 10
    for bundle, hits in ((dec.BUNDLE, dec.HITS), (20, 3)):  # all items of a text together, and few at a time
        monkeypatch.setattr(dec, "BUNDLE", bundle)
        monkeypatch.setattr(dec, "HITS", hits)
        assert plain(dec.find_overlaps(frame, bench, min_tokens=1)) == want
        clean = dec.decontaminate(frame, bench, min_tokens=1)
        assert clean.columns == frame.columns
        hit = {(d, t) for d, t in docs if brute([(d, t)], items)}
        assert sorted(map(repr, [(r.doc_id, r.text) for r in clean.collect()])) == sorted(repr(r) for r in docs if r not in hit)
    for a, b in ((frame.limit(0), bench), (frame, bench.limit(0))):
        assert dec.find_overlaps(a, b).count() == 0
        assert dec.decontaminate(a, b).count() == a.count()


def test_op7_finds_whole_items(spark):
    docs = [(r.doc_id, " " + " ".join(tokens(r.text)) + " ") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, w in items if len(w) >= dec.SPAN and f" {' '.join(w)} " in t}
    got = {(r.doc_id, r.item_id): r for r in dec.op7_spaced_seed_overlaps(spark, SF_SMALL).collect()}
    assert whole and whole <= set(got)
    assert all(got[p].n_equal == got[p].n_item for p in whole)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "What is it?"), (2, "什么是光合作用"), (3, "植物如何利用阳光把水和二氧化碳变成糖"), (4, "ภาษาไทย"), (5, "?"), (6, "x"), (7, "what is it"), (None, "one two")]
    docs = [(1, "so WHAT is, it then; what is it"), (2, "我问什么是光合作用吗"), (3, "请问植物如何利用阳光把水和二氧化炭变成糖呢"), (4, "abcภาษาไทยx"), (5, "what is that"), (6, "一二什么是"), (7, "one"), (8, "two"), (9, None), (10, "One two")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = plain(dec.find_overlaps(frame, bench, min_tokens=1))
    assert got == sorted([(1, 1, 3, 3, 0, 1), (1, 7, 3, 3, 0, 1), (2, 2, 7, 7, 0, 2), (3, 3, 17, 18, 0, 2), (4, 4, 7, 7, 0, 1), (4, 6, 1, 1, 0, 8), (10, None, 2, 2, 0, 0)], key=repr)
    clean = dec.decontaminate(frame, bench, min_tokens=1)
    assert sorted(r.doc_id for r in clean.collect()) == [5, 6, 7, 8, 9]


def test_op7_and_pipeline_search_short_items(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "so what is it then"), (2, "what was it")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "What is it?"), (6, "was"), (7, "so what")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id, r.n_equal, r.n_item, r.doc_from) for r in dec.op7_spaced_seed_overlaps(spark, str(tmp_path)).collect()]
    assert got == [(1, 5, 3, 3, 1)]
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_stretch_equals_all_pairs_and_takes_long_items():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        equal = rng.random(rng.integers(1, 30)) < rng.choice([0.3, 0.7, 0.9])
        a = int(rng.integers(0, len(equal)))
        b = int(rng.integers(a + 1, len(equal) + 1))
        best = (0, 0)
        for s in np.flatnonzero(equal):
            for e in np.flatnonzero(equal) + 1:
                core = np.flatnonzero(equal[a:b])
                if not len(core) or s > a + core[0] or e < a + core[-1] + 1:
                    continue
                if 5 * equal[s:e].sum() >= 4 * (e - s) and e - s > best[1] - best[0]:
                    best = (int(s), int(e))
        assert dec.stretch(equal, a, b) == best
    equal = rng.random(200_000) < 0.9
    a, b = dec.stretch(equal, 100_000, 100_010)  # a matrix of this would take 60 GB
    assert b - a > 190_000


def test_one_substitution_at_every_length_and_place():
    rng = random.Random(9)
    for n in range(1, 31):
        masks = dec.short_masks(n) if n < dec.MIN_LENGTH else dec.MASKS
        assert all(masks) and (n < 5 or len(masks) > 1)
        item = np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)
        for place in range(n):
            text = np.array([rng.getrandbits(63) for _ in range(n + 9)], np.uint64)
            text[4 : 4 + n] = item
            text[4 + place] = 7
            mine = set(np.concatenate([*(dec.seed_hashes(text, m) for m in range(10)), *(h for h in dec.short_hashes(text, min(n, 11)))]).tolist())
            seeded = any(mine & set(h.tolist()) for h in dec.item_hashes(item))
            found = dec.overlaps(text, [item])
            # of 12 tokens, a changed first or last one leaves a stretch of 11
            assert (seeded, bool(found)) == (n >= 5, n >= 5 and not (n == 12 and place in (0, 11))), (n, place)


def test_few_items_too_short_are_left_out(spark):
    bench = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "a b c"), (4, None), (5, ""), (6, "a")], "item_id long, text string")
    assert sorted((r.item_id, r.n_tokens) for r in dec.left_out(bench).collect()) == [(1, 1), (2, 2), (5, 0), (6, 1)]
    docs = spark.createDataFrame([(1, "a b"), (2, "z a b c")], "doc_id long, text string")
    assert [(r.id, r.item) for r in dec.find_overlaps(docs, bench).collect()] == [(2, 3)]


def test_full_filter_repeated_documents_and_a_long_item(spark, monkeypatch):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    docs = [(i, "x " + long[100_000:400_000]) for i in range(3)] + [(9, other), (9, other), (None, other), (20, "a clean text of its own")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (2, other), (2, other), (None, other)], "item_id long, text string")
    monkeypatch.setattr(dec, "FILTER_BITS", 16)
    monkeypatch.setattr(dec.index, "__defaults__", (16,))  # a filter that lets nearly all through
    got = sorted(((r.id, r.item) for r in dec.find_overlaps(frame, bench).collect()), key=repr)
    assert got == sorted([(i, 1) for i in range(3)] + [(d, i) for d in (9, 9, None) for i in (2, 2, None)], key=repr)
    assert [r.doc_id for r in dec.decontaminate(frame, bench).collect()] == [20]
    plan = dec.decontaminate(frame, bench)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan
