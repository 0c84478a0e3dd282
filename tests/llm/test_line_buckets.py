"""Buckets of the same lines are looked at once, however many bands bring them together, and lines are digested many at once."""

import random

import numpy as np
import pytest

from traceloom.llm import hashing
from traceloom.llm import op8_line_dedup as op


def _buckets(spark, sets):
    return spark.createDataFrame([(key, item) for key, items in enumerate(sets) for item in items], "key bigint, item bigint").repartition(3)


def test_repeated_buckets_are_one(spark):
    """Sets that differ in one item, in their number of items or at an end only stay apart."""
    draw = random.Random(2)
    own = [[draw.randrange(-(2**63), 2**63) for _ in range(n)] for n in (2, 2, 3, 5, 40)]
    middle = sorted(own[4])
    other = [*middle[:20], middle[20] + 1, *middle[21:]]
    sets = [*own, *own, own[4], own[0][:1], other, middle[:-1], middle[:5] + middle[6:]]
    found = op._different_buckets(_buckets(spark, sets)).collect()
    kept = [sorted(sets[r["key"]]) for r in found]
    assert sorted(kept) == sorted({tuple(sorted(x)): sorted(x) for x in sets if len(x) > 1}.values())
    assert all((r["lead"], r["last"], r["n"]) == (x[0], x[-1], len(x)) for r, x in zip(found, kept, strict=True))


@pytest.mark.parametrize("times", [1, 12])
def test_rows_do_not_grow_with_bands(spark, monkeypatch, times):
    """The same pairs and groups in many bands give the same links from as many rows as in one band."""
    lines = ["the first words of a line that others nearly repeat, number " + str(i) for i in range(4)] + [x * 3 for x in ("quite another text ", "one more of them ")]
    texts = dict(enumerate(lines))
    held = {}
    store = op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, tag: held.setdefault(tag, store(df, tag)) if tag in ("members", "pairs") else store(df, tag))

    def texts_of(some):
        rows = some.sparkSession.createDataFrame([(r["item"], texts[r["item"]]) for r in some.collect()], "item bigint, text string")
        return rows.mapInPandas(op._sketched, op._TEXTS)

    op.ship(spark)
    links = {(r["a"], r["b"]) for r in op._links(_buckets(spark, [(0, 1, 2, 3), (4, 5), (0, 5)] * times), texts_of).collect()}
    assert links == {(1, 0), (2, 0), (3, 0)}
    assert held["members"].count() == 4 and held["pairs"].count() == 5


def test_digests_of_many_lines():
    lines = ["", "x", "\ud800 alone", "ein längerer Text " * 50]
    assert op._line_digests(lines).tolist() == [op.line_digest(x) for x in lines] and len(op._line_digests([])) == 0


def test_numbers_of_distinct_values_as_far_as_each_needs():
    draw = np.random.default_rng(5)
    arrays = [draw.integers(0, 1 << 63, size=n, dtype=np.uint64)[draw.integers(0, n, size=300)] for n in (1, 50, 120, 200, 3000)] * 9
    exact = np.array([len(np.unique(x)) for x in arrays])
    enough = np.where(np.arange(len(arrays)) % 2, 160, 214)
    found = hashing.distinct_at_least(arrays, enough)
    assert (found <= exact).all() and ((found == exact) | (found >= enough)).all()
