"""Words of long texts, piece by piece, are the words of the whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from attrition.llm import common


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_pieces_equal_the_whole(monkeypatch, plain, size):
    rng = np.random.default_rng(size)
    letters = list("abXY .,\n\t") + ["é", "漢", "字", "ไ", "𠀀"]
    for _ in range(40):
        texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(rng.integers(0, 9))] + [None, "", "z" * 70]
        buffer = common.text_buffer(pa.array(texts, pa.string()))
        monkeypatch.setattr(common, "PIECE_BYTES", 1 << 30)
        a = common.split_words(*buffer, lower=True, plain=plain)
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        b = common.split_words(*buffer, lower=True, plain=plain)
        for name in ("start", "end", "hash", "first"):
            assert getattr(a, name).tolist() == getattr(b, name).tolist()


def test_memory_of_a_long_text():
    import tracemalloc

    data = np.frombuffer(b"some words of a text " * 2_000_000, np.uint8)  # 42 MB
    tracemalloc.start()
    words = common.split_words(data, np.array([0, len(data)]), lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.hash) == 10_000_000
    assert peak < 18 * len(data)
