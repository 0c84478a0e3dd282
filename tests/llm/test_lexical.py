"""Ranked lexical search against scores worked out document by document."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from traceloom.llm import op13_lexical as op

DOCS = "doc_id bigint, text string, n string, codes string, item_id string, rank string"
ITEMS = "item_id bigint, text string, doc_id string, score string"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k):
    words = [(i, Counter(_terms(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    count, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in words:
            m = 100 - 50 + (50 * sum(c.values()) * count) // total
            score = sum(floor(1000 * log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def _fixture(seed, count=300):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.6)) % 500}" for _ in range(3000)] + ["Straße", "日本", "É x", "A1b2", "ÀÉ"]
    texts = [draw.choice([" ", ", ", "-", "\n", "\x00"]).join(draw.choice(words) for _ in range(draw.randrange(1, 90))) for _ in range(count)]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs += docs[:3] + [(0, texts[5]), (None, texts[6]), (None, texts[6]), (5000, None), (5001, ""), (5002, " .,;\n"), (5003, "w1 " * 40_000)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 12)))) for i in range(25)]
    items += [items[0], (1, "w2 w3"), (100, None), (101, "!!"), (102, "unheard of"), (None, "w4 W1"), (103, texts[9])]
    return docs, items


@pytest.mark.parametrize("k,group_bytes", [(50, op.GROUP_BYTES), (4, 400), (1, op.GROUP_BYTES)])
def test_against_brute_force(spark, k, group_bytes):
    docs, items = _fixture(11)
    frame = spark.createDataFrame([(*d, "clash", "clash", "clash", "clash") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, "clash", "clash") for i in items], ITEMS).repartition(2)
    found = op.lexical_search(frame, asked, k, group_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == _brute(docs, items, k)


def test_many_blocks_share_their_bounds(spark):
    """Blocks of 16 documents in one task: the k-th score of earlier blocks limits later ones, and the result stays whole."""
    docs, items = _fixture(13)
    frame, asked = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert sorted([tuple(r) for r in op.lexical_search(frame, asked, 5).collect()], key=repr) == _brute(docs, items, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_accumulators_are_limited():
    """With the three best held by a rare term, documents that only hold the frequent term get no accumulator."""
    n = 1000
    codes = [[0, 1] if i < 3 else [1] for i in range(n)]
    lists = lambda values, kind: pa.array(values, pa.list_(kind))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([50] * n, pa.int64()), lists(codes, pa.int32()), lists([[1] * len(c) for c in codes], pa.int64())],
        names=["doc_id", "n", "codes", "times"],
    )
    block = op._Block(batch, n, 50 * n)
    found, scores = block.best(np.array([0, 1], np.int32), np.array([6000, 10]), 3, 0)
    assert found.tolist() == [0, 1, 2] and (scores == 6010 * (10**9 // (1000 + 20 * 100))).all()
    # A score held from elsewhere that this block cannot reach: nothing comes out of it.
    assert len(block.best(np.array([0, 1], np.int32), np.array([6000, 10]), 3, 10**12)[0]) == 0


def test_lengths_beyond_64_bits():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([10**12]), pa.array([[0]], pa.list_(pa.int32())), pa.array([[10**6]], pa.list_(pa.int64()))], names=["doc_id", "n", "codes", "times"]
    )
    m = 50 + 50 * 10**12 * 10**10 // 10**13
    assert op._Block(batch, 10**10, 10**13).parts.tolist() == [10**15 // (10**9 + 20 * m)]


@pytest.mark.parametrize("docs,items", [([], []), ([(1, "a")], []), ([], [(1, "a")]), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "")])])
def test_empty(spark, docs, items):
    found = op.lexical_search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert found.collect() == []
