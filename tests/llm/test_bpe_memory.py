"""What the store of encoded chunks takes for each character it holds."""

import random
import tracemalloc

import pytest

from traceloom.llm import op9_bpe


def test_held_chunks_are_small():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    draw, codec = random.Random(8), op9_bpe.Codec(path)
    texts = [" ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randrange(2, 9))) for _ in range(700)) for _ in range(300)]
    codec.encode(texts.pop())  # tables that are made once
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for text in texts:
            codec.encode(text)
        taken = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert codec._held > 1_000_000
    assert taken < 6 * codec._held
    assert all(codec.encode(t) == codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:20])
