"""Operator 11 against the tokenizers library and against merging by rule."""

from __future__ import annotations

import hashlib
import json
import random
import sys

import numpy as np
import pytest

from attrition.llm import backtrack
from tests.conftest import SF_SMALL

VOCABULARY = backtrack.default_vocabulary()


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, encoding="utf-8") as f:
        return backtrack.BacktrackingCodec(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def merged(v: backtrack.Vocabulary, data: bytes) -> list[int]:
    """The rule itself: the leftmost pair of the earliest merge, again and again."""
    ids = list(data)
    while True:
        due = [v.joined.get(p, sys.maxsize) for p in zip(ids, ids[1:], strict=False)]
        if not due or min(due) == sys.maxsize:
            return ids
        i = due.index(min(due))
        ids[i : i + 2] = [due[i]]


def small_vocabulary(seed: int, letters: str = "abc", merges: int = 40) -> str:
    """A file of random merges over a few letters (some tokens can never be made)."""
    rng = random.Random(seed)
    names = list(backtrack.byte_of_char())
    tokens, pairs = list(letters), []
    for _ in range(merges):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            pairs.append([a, b])
    order = names + [a + b for a, b in pairs]
    rng.shuffle(order)  # ids need not follow the merges
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(order)}, "merges": pairs}
    return json.dumps({"model": model, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []})


@pytest.mark.parametrize("seed", range(12))
def test_equals_merging_for_random_merges(seed):
    codec = backtrack.BacktrackingCodec(small_vocabulary(seed))
    rng = random.Random(seed)
    for _ in range(400):
        data = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode()
        assert codec.encode_match(data.decode()) == merged(codec.vocabulary, data)


def odd_texts() -> list[str]:
    rng = random.Random(3)
    words = ["hello", "don't", "it's", "Ωmega", "naïve", "日本語", "ไทย", "🙂", "  ", "\n\n", "\t", "x1y2", "१२३", "é", " ", " ", "\x85", "\x1c", "<|endoftext|>", "<|endof", "'ll", "!!", "..."]
    made = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    return [*made, "", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>" * 3, " <|endoftext|> x", "the " * 2000, "é" * 2000, "\x00\x01"]


def test_ids_and_texts_equal_the_library(codec, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, off = codec.encode([t.encode() for t in texts])
    for t, w, x, y in zip(texts, want, off[:-1], off[1:], strict=True):
        assert ids[x:y].tolist() == w, t
        assert codec.decode(ids[x:y]).decode() == library.decode(w, skip_special_tokens=False)


def test_every_character_equals_the_library(codec, library):
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{chr(p)} {chr(p)}1 {chr(p)}{chr(p)}" for p in points[i : i + 64]) for i in range(0, len(points), 64)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, off = codec.encode([t.encode() for t in texts])
    assert [ids[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == want


def test_decoding_any_ids(codec, library):
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([-1, 60_000, 64])) == b"a"


def test_long_texts_go_through_in_slices(codec, library, monkeypatch):
    monkeypatch.setattr(backtrack, "SLICE_BYTES", 50)
    text = " ".join(random.Random(2).choice(["word", "日本 x", "a" * 90, "1.5", "\n"]) for _ in range(400))
    assert max(len(p) for p in codec.parts(text.encode()) if not isinstance(p, int)) < 250
    assert codec.encode([text.encode(), b"x"])[0].tolist()[:-1] == library.encode(text, add_special_tokens=False).ids


def test_long_match_is_linear(codec):
    data = b"abcde" * 400_000  # one match of 2 MB
    ids, off = codec.encode([data])
    assert codec.decode(ids) == data and len(off) == 2


def test_refuses_other_models():
    spec = json.loads(small_vocabulary(0))
    spec["model"]["ignore_merges"] = True
    with pytest.raises(ValueError, match="ignore_merges"):
        backtrack.Vocabulary(json.dumps(spec))


def test_tables_round_trip(spark):
    rows = [(1, "a <|endoftext|> b", "k"), (1, "a <|endoftext|> b", "k"), (None, None, "n"), (3, "", "e"), (4, "x " * 700_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = backtrack.encode_documents(docs, VOCABULARY)
    back = backtrack.decode_documents(encoded, VOCABULARY)
    have = sorted(((r.doc_id or -1), r.text) for r in back.collect())
    assert have == sorted(((i or -1), t or "") for i, t, _ in rows)
    assert backtrack.encode_documents(docs.limit(0), VOCABULARY).count() == 0


def test_op11_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = backtrack.op11_backtracking_bpe(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
