"""Operators 1 and 5 against the public libraries, byte for byte."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from attrition.llm import bpe, token_files
from attrition.llm.common import shared_folder
from tests.conftest import SF_SMALL

VOCABULARY, PATTERN = bpe.default_vocabulary()
ODD = [
    None, "", " ", "  ", "\n\n a", "a" * 700 + "b" * 900, " " * 1500, "ab" * 2000, "x  y", "x  y", "x   y",
    "I'll we've it's", "　a 　 b", "<|endoftext|> x", "é \U0001f600‍", "tab\t tab", "end ", "漢字 漢字", "\x1c \x85 q",
]


def random_texts(n: int = 400) -> list[str]:
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "a", "b", "é", "'s", "1", "٣", "漢", "!", "\t", " ", "the", " of", "　"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def library_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def rows_with_clashes(spark, texts):
    """Documents with repeated ids and extra columns named like internal ones."""
    rows = [(i // 2 if i > 3 else None, t, "z", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids int")


def test_codec_equals_library_on_random_and_odd_texts():
    codec = bpe.BytePairCodec(bpe.read_ranks(VOCABULARY), PATTERN)
    want = library_encoder()
    texts = [t or "" for t in ODD] + random_texts()
    ids, off = codec.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        got = ids[off[i] : off[i + 1]]
        assert got.tolist() == want.encode_ordinary(t), repr(t)
        assert codec.decode(got).tobytes() == t.encode()


def test_heap_and_matrix_merge_alike():
    codec = bpe.BytePairCodec(bpe.read_ranks(VOCABULARY), PATTERN)
    rng = random.Random(1)
    for _ in range(60):
        word = bytes(rng.choice(b"thereandion") for _ in range(rng.randint(2, 200)))
        ids, at, n = codec.merge_all([word])
        slow = codec._merge_long(codec.byte_id[np.frombuffer(word, np.uint8)].tolist())
        assert ids[at[0] : at[0] + n[0]].tolist() == slow.tolist()


def test_emptying_the_cache_changes_nothing():
    codec = bpe.BytePairCodec(bpe.read_ranks(VOCABULARY), PATTERN)
    codec.cache.limit = 3
    want = library_encoder()
    for t in random_texts(80):
        assert codec.encode([t.encode()])[0].tolist() == want.encode_ordinary(t)


def test_op1_digests_equal_library(spark):
    want = library_encoder()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.op1_byte_bpe(spark, SF_SMALL).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_then_decode_documents(spark):
    docs = rows_with_clashes(spark, ODD)
    back = bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY, PATTERN), VOCABULARY)
    assert sorted(bytes(r.payload) for r in back.collect()) == sorted((t or "").encode() for t in ODD)
    empty = docs.limit(0)
    assert bpe.encode_documents(empty, VOCABULARY, PATTERN).count() == 0
    assert bpe.encode_digests(empty, VOCABULARY, PATTERN).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def test_op5_equals_library_in_id_order(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in token_files.op5_token_files(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    start = 0
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_are_equal_length_sequences_with_masks(spark, library):
    docs = rows_with_clashes(spark, ODD + random_texts(50))
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = token_files.write_token_files(docs, path, shared_folder(spark, "t"), width=8).collect()
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) for t in ODD + random_texts(50))
    got = []
    for file in {r.file for r in index}:
        reader = token_files.SequenceReader(file)
        total = sum(r.n for r in index if r.file == file)
        for k in range(-(-total // 8)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 8 and not ids.flags.owndata
            assert mask.tolist() == [k * 8 + i < total for i in range(8)]
        got += [tuple(reader.tokens(r.at, r.n)[:-1].tolist()) for r in index if r.file == file]
    assert sorted(got) == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path, shared_folder(spark, "t"))).count() == 0


def test_op5_gives_added_tokens_the_ids_of_the_librarys_default(spark, tmp_path):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a <|endoftext|> x", "a  <|endoftext|>  x  y", "a\n <|endoftext|><|endoftext|>", "plain  text", None, *ODD]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in token_files.op5_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*default.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_vocabularies_of_one_size_keep_their_own_codec(spark, tmp_path):
    """Two vocabularies that differ in one merge, in the same workers."""
    import base64

    import tiktoken

    docs = spark.createDataFrame([(1, "abcd abcd")], "doc_id long, text string").coalesce(1)
    for name, joined in (("one", (b"ab", b"cd")), ("two", (b"bc", b"da"))):
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(joined)}
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.writelines(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
        want = tiktoken.Encoding(name, pat_str=r"\w+|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary("abcd abcd")
        encoded = bpe.encode_documents(docs, path, r"\w+|\s+")
        assert encoded.first().ids == want
        assert bpe.decode_documents(encoded, path).first().payload == b"abcd abcd"
    assert bpe.worker_codec(ranks, r"\w+") is not bpe.worker_codec(ranks, r"\s+")
    assert bpe.worker_codec(ranks, None) is bpe.worker_codec(ranks, r"\w+")
