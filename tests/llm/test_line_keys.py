"""Packed band keys of lines against brute force: every key that two lines share comes back with all its lines."""

import collections
import random

import numpy as np
import pytest

from traceloom.llm import hashing
from traceloom.llm import op8_line_dedup as op


@pytest.mark.parametrize("bits", [1, 5, 17, 40])
def test_keys_come_back(bits):
    keys = hashing.stream(9, 1000)
    cells, low = op._cell_keys(keys, bits)
    assert (op._unpack(op._pack(low)) == low).all() and int(cells.max()) < 1 << bits
    whole = op._whole_keys(cells, low, bits).view(np.uint64)
    dropped = np.uint64(max(0, 16 - bits))
    assert (whole >> dropped == keys >> dropped).all()


@pytest.mark.parametrize(("run", "seen", "cell"), [(7, 5, 64), (1 << 15, 1 << 18, 1 << 19)])
def test_shared_buckets(spark, monkeypatch, run, seen, cell):
    """A third of the lines are variants of one, so their keys are hot; lines repeat over documents and partitions."""
    for name, value in (("RUN", run), ("SEEN", seen), ("CELL", cell)):
        monkeypatch.setattr(op, name, value)
    draw = random.Random(4)
    hot = "a line that stands in very many documents with one small change at its end, number"
    lines = [f"{hot} {i}" for i in range(60)] + [" ".join(f"w{draw.randrange(10**5)}" for _ in range(9)) for _ in range(100)] + ["x", "short"]
    held = [draw.choice(lines) for _ in range(400)] + lines
    rows = [(i, "\n".join(held[i : i + 5])) for i in range(0, len(held), 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    op.ship(spark)
    found = {(r.key, r.item) for r in op.shared_buckets(op._named(docs), len(lines)).collect()}
    buckets = collections.defaultdict(set)
    keys = hashing.wide_band_keys(hashing.minhashes(hashing.char_shingles(lines, op.WIDTH), op.BANDS * op.ROWS), op.BANDS, op.ROWS)
    bits = max(1, int(np.ceil(np.log2(max(2, len(lines) * op.BANDS / cell)))))
    for line, row in zip(lines, keys, strict=True):
        for key in op._whole_keys(*op._cell_keys(row.view(np.uint64), bits), bits):
            buckets[int(key)].add(op.line_digest(line))
    expected = {(k, i) for k, own in buckets.items() if len(own) > 1 for i in own}
    # Keys of one line may come back too (a line known from several runs); all of several lines must.
    assert expected <= found and {k for k, _ in found} == {k for k, _ in expected}


def test_pairs_are_counted_exactly(monkeypatch):
    """Shared shingles of pairs, in runs of a few pairs, against sets; empty frames and one-character lines included."""
    import pandas as pd

    draw = random.Random(6)
    lines = ["".join(draw.choice("abcd ") for _ in range(draw.randrange(1, 90))) for _ in range(40)]
    lines += [x[:-1] + "z" for x in lines[:20]] + ["x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaa"]
    sets = [set(hashing.char_shingles([x], op.WIDTH)[0].tolist()) for x in lines]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    frame = pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "ta": [lines[a] for a, _ in pairs], "tb": [lines[b] for _, b in pairs]})
    expected = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    for most in (1, 500, op.AT_ONCE):
        monkeypatch.setattr(op, "AT_ONCE", most)
        found = pd.concat(list(op._confirmed(iter([frame.iloc[:0], frame]))))
        assert set(zip(found["a"], found["b"])) == expected and len(found) == len(expected) > 5
