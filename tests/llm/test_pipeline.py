"""The corpus pipeline, stage by stage, against the brute-force versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrition.llm import bpe, language, simhash
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import tokens
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_substrings import brute as brute_repeats


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = [(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7), (10_003, "", "fr", "s", 0)]
    out = [docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_SMALL).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_language_stage_keeps_documents_and_rejects_the_unplaceable(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(before) - set(after) == {10_001, 10_002, 10_003}
    assert all(after[i] == before[i] for i in after)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = rows(stages[1]), rows(stages[2])
    group = slow_components({i: slow_fingerprint(r.text) for i, r in before.items()})
    assert set(after) == set(group.values()) < set(before)
    assert all(after[i] == before[i] for i in after)


def test_passage_stage_cuts_repeats(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {i: (t, n) for i, t, n in brute_repeats([(i, r.text) for i, r in before.items()], 50)}
    assert set(after) == {i for i, (t, n) in want.items() if t or not n}
    for i, r in after.items():
        if want[i][1]:
            assert (r.text, r.n_chars) == (want[i][0], len(want[i][0]))
        else:
            assert r == before[i]


def test_decontamination_stage_drops_planted_items_only(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [" ".join(tokens(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    planted = {i for i, r in before.items() if any(f" {t} " in f" {' '.join(tokens(r.text))} " for t in items)}
    assert planted and not planted & set(after)
    grams = {tuple(t.split()[k : k + 8]) for t in items for k in range(len(t.split()) - 7)}
    for i in set(before) - set(after) - planted:
        w = tokens(before[i].text)
        assert any(tuple(w[k : k + 8]) in grams for k in range(len(w)))
    assert all(after[i] == before[i] for i in after)


def test_encoding_stage_and_run(spark, stages):
    import tiktoken

    vocabulary, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(vocabulary), special_tokens={})
    before, after = rows(stages[4]), rows(stages[5])
    assert set(before) == set(after)
    for i, r in after.items():
        assert list(r.ids) == library.encode_ordinary(before[i].text)
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
    ran = rows(corpus_pipeline.run(spark, SF_SMALL))
    assert set(ran) == set(after) and all(ran[i].ids_sha256 == after[i].ids_sha256 for i in ran)


def test_keep_one_with_repeats_nulls_and_clashing_names(spark):
    data = [(5, "a b c d", 1), (5, "a b c d", 1), (3, "a b c d", 2), (None, "a b c d", 3), (None, None, 4), (8, None, 5), (9, "", 6), (2, "p q r s t", 7), (2, "u v w x y", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, mark int").withColumn("c0", F.lit("x"))
    got = [(r.doc_id, r.text, r.mark) for r in simhash.keep_one(docs).collect()]
    want = [(3, "a b c d", 2), (None, "a b c d", 3), (None, None, 4), (8, None, 5), (2, "p q r s t", 7), (2, "u v w x y", 7)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0
    assert language.UNKNOWN == "und"
