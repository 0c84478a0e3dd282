"""Mixing counts every row: rows without an id, repeated ids, and groups of equal rows larger than a chunk."""

import collections

import pytest

from traceloom.llm import op10_mixing as op

FORM = "doc_id bigint, text string, source string, _row string, _nth string, nth string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], FORM).repartition(4)


def test_rows_without_ids_come_near_their_targets(spark):
    """400 rows of four words, none with an id, in four sources of 400 words each."""
    rows = [(None, "a b c d", f"s{i % 4}") for i in range(400)]
    found = op.mix(_frame(spark, rows)).collect()
    assert len(found) == 400 and all(r["taken"] <= 12 for r in found)
    taken = collections.defaultdict(int)
    for r in found:
        taken[round(r["target"], 6)] += r["taken"]
    assert sorted(round(t) for t in taken) == [123, 246, 615]
    for target in taken:  # two sources weigh 5
        sources = sum(round(r["target"], 6) == target for r in found) // 100
        assert abs(taken[target] - sources * target) <= 4 * sources


def test_repeated_rows_are_taken_each_for_itself(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 7)
    rows = [(i % 3, "one two three", "s0") for i in range(90)] + [(100 + i, "w " * (1 + i % 5), "s1") for i in range(40)] + [(None, None, None), (5, "", "s1")]
    found = op.mix(_frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for target in {r["target"] for r in found}:
        assert abs(sum(r["taken"] for r in found if r["target"] == target) - target) <= 5
    again = op.mix(_frame(spark, rows)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mixed_rows_are_those_of_the_mix(spark):
    rows = [(None, f"t{i % 7} b c", f"s{i % 2}") for i in range(60)] + [(i // 2, f"x{i} y", "s2") for i in range(30)] + [(900, "alone here", "s2")]
    frame = _frame(spark, rows)
    out = op.mixed(frame)
    assert out.columns == frame.columns
    got = collections.Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in out.collect())
    expected = collections.Counter()
    for r in op.copies(frame).collect():
        expected[r["doc_id"], r["size"], r["source"]] += r["copies"]
    assert got == +expected
    assert {r["text"] for r in out.collect()} <= {t for _, t, _ in rows}
