"""Near-dedup in many small blocks, and groups of texts around the threshold."""

import random

import pytest

from traceloom.llm import candidates, full_sets, op4_near_dedup


def _sets(rows):
    found = []
    for _, text in rows:
        words = (text or "").lower().split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return found


def _brute(rows):
    sets, root = _sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        held = least.get(find(i))
        least[find(i)] = doc if held is None else held if doc is None else min(held, doc)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def _group(draw, name, size, words, edits):
    base = [f"{name}{i}" for i in range(words)]
    out = []
    for n in range(size):
        own = list(base)
        for at in draw.sample(range(words), edits(n)):
            own[at] = f"{name}x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def _rows(seed):
    draw = random.Random(seed)
    texts = _group(draw, "a", 40, 80, lambda n: 1 + n % 4) + _group(draw, "b", 30, 120, lambda n: n % 3) + _group(draw, "c", 25, 60, lambda n: 2 + n % 2)
    texts += texts[:10] + [None, "", "one two", "One  two", "x" * 40_000]
    rows = [(i * 7 % 499, t) for i, t in enumerate(texts)]
    return rows + [rows[1], (rows[2][0], texts[60]), (None, texts[3]), (None, texts[3]), (None, "without an id and alone here")]


@pytest.mark.parametrize("block,cell", [(512, 1 << 18), (3, 1 << 18), (8, 500)])
def test_blocks_against_all_pairs(spark, monkeypatch, block, cell):
    monkeypatch.setattr(candidates, "BLOCK", block)
    monkeypatch.setattr(candidates, "CELL", cell)
    rows = _rows(block)
    found = op4_near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == _brute(rows)


def test_sent_digests_are_only_a_plan(spark, monkeypatch):
    monkeypatch.setattr(full_sets, "SENT_BYTES", 0)
    rows = _rows(5)
    found = op4_near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == _brute(rows)


def test_rows_of_each_step_stay_in_proportion(spark, monkeypatch):
    """A group of texts just below the threshold: twice the texts, at most about twice the rows out of every step."""
    store, sizes = candidates.materialize, {}

    def counted(df, tag):
        out = store(df, tag)
        sizes.setdefault(count, {}).setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(candidates, "materialize", counted)
    draw = random.Random(3)
    for count in (150, 300):
        rows = list(enumerate(_group(draw, "a", count, 80, lambda n: 2 + n % 3)))
        op4_near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    for tag in sizes[150]:
        for small, large in zip(sizes[150][tag], sizes[300][tag], strict=True):
            assert large <= 3 * small + 100, (tag, sizes)
