"""Operator 11: BPE encoding by backtracking over longest matches, and decoding.

The merges of a byte-level tokenizer file (JSON) give every token an order number:
bytes first, then the merges as listed. A match of the pre-tokenizer's pattern is
encoded in three steps, in time linear in its length:

1. One Aho-Corasick pass over its bytes gives the longest token that starts at each
   byte.
2. From the left, the longest token is taken. It may stand behind the token before it
   only if the two would stay apart under the merges (*pair compatibility*): undoing
   the later of the two merges step by step, no pair across the border may have been
   due earlier. Answers are kept in a table.
3. A token that may not stand there gives way to its longest prefix that is a token;
   when none is left, the place is marked dead and the token before it is taken back.
   A dead place is never entered again, so no place is given up twice.

The only sequence of tokens whose neighbours are all compatible is the one that the
merges give, so the result equals merging.

Added tokens of the file are found first (leftmost, longest) and part the text.
Between them texts are cut at blanks that no match crosses, and each distinct piece is
encoded once a worker. Texts over ``SLICE_BYTES`` go through slice by slice, so memory
does not grow with the text (it does with the longest stretch without such a blank,
by some 80 bytes a byte).

Decoding gathers the bytes of the ids through a table of offsets; bytes that are not
UTF-8 become U+FFFD, and ids without a token are skipped.

Both directions run in a map over the scan; nothing is shuffled. What goes to the
workers is the vocabulary file.

Defined results: null text encodes as empty; an empty text has no ids and decodes to
an empty text. Repeated rows are encoded each, a null id is kept, other columns are
not read (whatever their names), an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.bpe import PieceCache, text_bytes
from attrition.llm.common import by_bytes, expand, map_arrow, table

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
TABLE_PAIRS = 1_000_000
MEMO_MATCHES = 300_000

#: Fixed value: the pattern of byte-level pre-tokenizers with ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(rb" (?=[!-~\xc3-\xdf])")


def byte_of_char() -> dict[str, int]:
    """The file's one-character names of bytes: visible bytes name themselves, the
    others are numbered from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in own}
    names.update({chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)).difference(own)))})
    return names


def _require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {what}")


class Vocabulary:
    """Tokens by order number (bytes, then merges), their ids, and added tokens."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        _require(model["type"] == "BPE", "model")
        _require(not spec.get("normalizer"), "normalizer")
        _require(bool(pre) and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"), "pre_tokenizer")
        for switch in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
            _require(not model.get(switch), switch)
        byte = byte_of_char()
        self.ids: list[int] = [0] * 256
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        for char, b in byte.items():
            _require(char in model["vocab"], f"byte {b} has no token")
            self.ids[b] = model["vocab"][char]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            parts = tuple(number.get(bytes(byte[c] for c in x), -1) for x in (a, b))
            token = bytes(byte[c] for c in a + b)
            _require(min(parts) >= 0 and token not in number, f"merge {a} {b}")
            number[token] = self.joined[parts] = len(self.tokens)
            self.tokens.append(token)
            self.ids.append(model["vocab"][a + b])
            self.left.append(parts[0])
            self.right.append(parts[1])
        self.added: dict[bytes, int] = {}
        for t in spec.get("added_tokens") or []:
            _require(not (t["single_word"] or t["lstrip"] or t["rstrip"]), f"added token {t['content']}")
            self.added[t["content"].encode()] = t["id"]
        self.number = number


def stay_apart(v: Vocabulary, a: int, b: int, bound: int = sys.maxsize) -> bool:
    """Whether tokens ``a`` and ``b``, side by side, are never merged across their
    border by a merge before ``bound``. Of equal merges the left one comes first."""
    while True:
        due = v.joined.get((a, b))
        if due is not None and due < bound:
            return False
        if a > b:
            bound, a = a, v.right[a]
        elif b >= 256:
            bound, b = b + 1, v.left[b]
        else:
            return True
        if bound < 256:
            return True


class BacktrackingCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: str):
        import ahocorasick
        import regex

        v = self.vocabulary = Vocabulary(content)
        self.find = regex.compile(PATTERN).findall
        self.length = [len(t) for t in v.tokens]
        # a token that the merges never make from its own bytes is never taken
        made = [True] * 256
        for i in range(256, len(v.tokens)):
            a, b = v.left[i], v.right[i]
            made.append(made[a] and made[b] and stay_apart(v, a, b, i))
        names = [t.decode("latin-1") for t in v.tokens]  # one character a byte
        self.whole = {t: i for i, t in enumerate(names) if made[i]}
        automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(names)
        for token, i in self.whole.items():
            automaton.add_word(token, (i, len(token) - 1))
            for cut in range(len(token) - 1, 0, -1):
                j = self.whole.get(token[:cut])
                if j is not None:
                    self.shorter[i] = j
                    break
        automaton.make_automaton()
        self.matches = automaton.iter
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.ids = np.array(v.ids, np.int64)
        self.added = re.compile(b"|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None
        self._offset_tables(dict(zip(v.ids, v.tokens, strict=True)) | {i: t for t, i in v.added.items()})
        self.cache = PieceCache(self.encode_pieces)

    def _offset_tables(self, token_of: dict[int, bytes]) -> None:
        """Bytes of each id, and its decimal form after a comma, as one array each
        with the ids' offsets (ids without a token have no bytes)."""
        size = max(token_of) + 1
        self.bytes_at = np.zeros(size + 1, np.int64)
        self.digits_at = np.zeros(size + 1, np.int64)
        self.bytes_at[1:] = np.cumsum([len(token_of.get(i, b"")) for i in range(size)])
        names = [b",%d" % i for i in range(size)]
        self.digits_at[1:] = np.cumsum([len(n) for n in names])
        self.bytes_flat = np.frombuffer(b"".join(token_of.get(i, b"") for i in range(size)), np.uint8)
        self.digits_flat = np.frombuffer(b"".join(names), np.uint8)

    # -- encoding ----------------------------------------------------------

    def encode_match(self, data: str) -> list[int]:
        """Order numbers of the tokens of one match of the pattern (a character a byte)."""
        one = self.whole.get(data)
        if one is not None:
            return [one]
        n = len(data)
        length, shorter, known = self.length, self.shorter, self.compatible.get
        longest = [0] * n
        for end, (token, before) in self.matches(data):
            longest[end - before] = token  # longer tokens of one start end later
        if len(self.compatible) > TABLE_PAIRS:
            self.compatible.clear()
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while True:
            end = at + length[token]
            if end not in dead:
                fits = last < 0 or known((last, token))
                if fits is None:
                    fits = self.compatible[last, token] = stay_apart(self.vocabulary, last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        memo = self.memo
        if len(memo) > MEMO_MATCHES:
            memo.clear()
        flat: list[int] = []
        ends: list[int] = []
        for piece in pieces:
            text = piece.decode("utf-8", "surrogateescape")
            # letters only, perhaps after one blank: one match
            for match in (text,) if text[text[:1] == " " :].isalpha() else self.find(text):
                tokens = memo.get(match)
                if tokens is None:
                    data = match if match.isascii() else match.encode("utf-8", "surrogateescape").decode("latin-1")
                    tokens = memo[match] = self.encode_match(data)
                flat += tokens
            ends.append(len(flat))
        return self.ids[np.array(flat, np.int64)].astype(np.int32), np.diff(np.array(ends, np.int64), prepend=0)

    def parts(self, text: bytes) -> Iterator[bytes | int]:
        """The text's slices and the ids of the added tokens between them."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from slices(text, at, m.start())
            yield self.vocabulary.added[m.group()]
            at = m.end()
        yield from slices(text, at, len(text))

    def encode_parts(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids of one text, part by part."""
        for part in self.parts(text):
            yield np.array([part], np.int32) if isinstance(part, int) else self.cache.encode([part])[0]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text)."""
        alone = [i for i, t in enumerate(texts) if len(t) > SLICE_BYTES or (self.added and self.added.search(t))]
        if not alone:
            return self.cache.encode(texts)
        rest = set(range(len(texts))).difference(alone)
        ids, off = self.cache.encode([texts[i] for i in sorted(rest)])
        got = dict(zip(sorted(rest), np.split(ids, off[1:-1]), strict=True)) if rest else {}
        for i in alone:
            got[i] = np.concatenate([np.zeros(0, np.int32), *self.encode_parts(texts[i])])
        every = [got[i] for i in range(len(texts))]
        return np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])])

    # -- decoding ----------------------------------------------------------

    def known(self, ids: np.ndarray) -> np.ndarray:
        ids = np.asarray(ids, np.int64)
        return ids[(ids >= 0) & (ids < len(self.bytes_at) - 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        ids = self.known(ids)
        data = self.bytes_flat[expand(self.bytes_at[ids], self.bytes_at[ids + 1] - self.bytes_at[ids])].tobytes()
        return data.decode("utf-8", "replace").encode()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a comma before each."""
        ids = np.asarray(ids, np.int64)
        return self.digits_flat[expand(self.digits_at[ids], self.digits_at[ids + 1] - self.digits_at[ids])].tobytes()


def slices(text: bytes, start: int, end: int) -> Iterator[bytes]:
    """``text[start:end]`` in slices of about ``SLICE_BYTES`` that begin at a blank
    which no match of the pattern crosses."""
    while end - start > SLICE_BYTES:
        m = _CUT.search(text, start + SLICE_BYTES, end)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    if start < end:
        yield text[start:end]


_CODECS: dict[str, BacktrackingCodec] = {}


def worker_codec(content: str) -> BacktrackingCodec:
    """One codec a worker process and vocabulary file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = BacktrackingCodec(content)
    return _CODECS[key]


def _content(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with ``ids`` (array of int) of every whole text."""
    content = _content(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(content.value)
        for b in by_bytes(batches, "text", BATCH_BYTES):
            ids, off = codec.encode(text_bytes(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` with ``text``: what the ids decode to (null ids: an empty text)."""
    content = _content(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(content.value)
        for b in batches:
            rows = [codec.decode(np.array([i for i in x or [] if i is not None], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], names=["id", "text"])

    picked = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the decimal ids joined by commas and
    of the text that they decode to."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    content = _content(docs, vocabulary)

    def long_text(codec: BacktrackingCodec, text: bytes) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for ids in codec.encode_parts(text):
            of_ids.update(codec.digits(ids)[0 if n else 1 :])
            of_text.update(codec.decode(ids))  # parts end at characters
            n += len(ids)
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(content.value)
        for b in by_bytes(batches, "text", BATCH_BYTES):
            texts = text_bytes(b.column(1))
            rows: list[tuple[int, str, str]] = []
            if len(texts) == 1:
                rows.append(long_text(codec, texts[0]))
            else:
                ids, off = codec.encode(texts)
                for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    mine = ids[x:y]
                    rows.append((y - x, hashlib.sha256(codec.digits(mine)[1:]).hexdigest(), hashlib.sha256(codec.decode(mine)).hexdigest()))
            n, of_ids, of_text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=names)

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_arrow(picked, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op11_backtracking_bpe": op11_backtracking_bpe}
