"""The Jaccard join against all pairs, with groups just above and just below the threshold, in many small cells."""

import random
import re

import numpy as np
import pytest

from traceloom.llm import op11_jaccard_join as op

FORM = "doc_id bigint, text string, item string, n string, root string, counts string"


def _set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def _brute(docs):
    sets = [_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        held = least.get(find(i))
        least[find(i)] = doc if held is None else held if doc is None else min(held, doc)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def _changed(draw, words, times):
    own = list(words)
    for at in draw.sample(range(len(own)), times):
        own[at] = f"x{draw.randrange(10**6)}"
    return own


def _fixture(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{int(draw.paretovariate(0.8))}" for _ in range(3000)]
    texts = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 200))] for _ in range(80)]
    for size, edits in ((60, 40), (90, 40), (200, 30), (400, 12)):  # groups whose members differ by one to six words
        base = [draw.choice(vocabulary) for _ in range(size)]
        texts += [_changed(draw, base, 1 + i % 6) for i in range(edits)]
    passage = [f"p{i}" for i in range(60)]
    texts += [passage + [draw.choice(vocabulary) for _ in range(draw.randrange(5, 80))] for _ in range(40)]
    chain = [f"c{i}" for i in range(150)]
    for _ in range(12):  # each near to the one before, the ends far apart
        chain = _changed(draw, chain, 1)
        texts.append(chain)
    joined = [draw.choice([" ", "  ", "\n", "\t"]).join(t) for t in texts]
    joined += joined[:15] + [joined[0].upper(), "", " \n", None, None, "one two", "ONE  two", "one", "é É", "x" * 30_000, " ".join(["same"] * 500)]
    docs = [(i * 13 % 997, t) for i, t in enumerate(joined)]
    return docs + [docs[3], (docs[4][0], docs[90][1]), (None, docs[5][1]), (None, "no id at all here"), (None, "no id at all here")]


@pytest.mark.parametrize("seed,cell", [(1, op.CELL), (2, 600), (3, 3000)])
def test_against_all_pairs(spark, seed, cell):
    docs = _fixture(seed)
    frame = spark.createDataFrame([(*d, "clash", "clash", "clash", "clash") for d in docs], FORM).repartition(5)
    found = op.jaccard_join(frame, cell)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == _brute(docs)


def test_sent_digests_are_only_a_plan(spark, monkeypatch):
    docs = _fixture(4)[:250]
    monkeypatch.setattr(op, "SENT_BYTES", 0)
    monkeypatch.setattr(op, "FAN", 2)
    found = op.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == _brute(docs)


def test_search_of_an_index():
    """DivideSkip over one index finds exactly the similar sets, whatever the number of long lists."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 10**9, size=120).astype(np.uint64)
    sets = []
    for i in range(150):
        own = base.copy()
        own[draw.choice(120, size=i % 15, replace=False)] = draw.integers(10**9, 2 * 10**9, size=i % 15)
        sets.append(np.unique(own[: 120 - i % 9]))
    sets.sort(key=len)
    index = op._Index(sets)
    some = 0
    for q in range(1, len(sets)):
        first = int(np.searchsorted(index.sizes, op.needed(index.sizes[q])))
        near = [j for j in range(first, q) if op._similar(len(np.intersect1d(sets[q], sets[j])), len(sets[q]), len(sets[j]))]
        assert index.search(q, np.arange(first, q)).tolist() == near
        some += len(near)
    assert some > 100


def test_links_stay_in_proportion():
    """A cell of united and of almost similar items puts out fewer links than items, however many pairs are similar."""
    import pyarrow as pa

    draw = np.random.default_rng(7)
    base = np.arange(300, dtype=np.int64)
    for count in (100, 200):
        rows = [np.where(np.isin(base, draw.choice(300, 7, replace=False)), draw.integers(10**6, 10**9, 300), base) for _ in range(count)]
        cell = pa.table({"token": [1] * count, "i": [0] * count, "j": [0] * count, "block": [0] * count, "guest": [False] * count, "item": range(count), "root": range(count), "n": [300] * count, "shingles": rows})
        links = op._search_cell(cell)
        assert 0 < links.num_rows < count


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, None)], [(5, "a b c d"), (4, "a b c d")]])
def test_small_tables(spark, rows):
    found = op.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == _brute(rows)
