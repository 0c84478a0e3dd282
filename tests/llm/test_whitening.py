"""Whitening against numpy on the same whole numbers, with odd vectors, repeated rows and clashing columns."""

from fractions import Fraction

import numpy as np
import pytest

from traceloom.llm import op12_whitening as op

FORM = "vec_id bigint, embedding array<float>, n string, component string, white string, x string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash") for i, v in rows], FORM).repartition(3)


def _vectors(n, width, seed):
    draw = np.random.default_rng(seed)
    out = draw.normal(size=(n, width)) @ draw.normal(size=(width, width)) * 0.3 + draw.normal(size=width)
    return [[float(np.float32(c)) for c in row] for row in out]


def _x(vectors):
    return np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000


def test_against_numpy(spark):
    whole = _vectors(300, 7, 1)
    whole += whole[:5]
    rows = list(enumerate(whole)) + [(None, whole[0]), (3, whole[1])]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] * 7), (903, [float("inf")] * 7), (904, []), (905, [1.0, 2.0])]
    found = op.whitened(_frame(spark, rows + odd)).collect()
    x = _x([v for _, v in rows])
    n, centred = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == n * 7 and {r["component"] for r in found} == set(range(1, 8)) and {r["n"] for r in found} == {n}
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    expected = centred @ vectors / np.sqrt(values)
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    ids = [i for i, _ in rows]
    assert set(by_row) == {(i, int(d)) for i, d in zip(ids, deviation, strict=True)}
    for c in range(7):
        own = np.array([by_row[i, int(d)][c + 1] for i, d in zip(ids, deviation, strict=True)])
        assert min(np.abs(own - expected[:, c]).max(), np.abs(own + expected[:, c]).max()) < 1e-8
    shares = {r["component"]: r["explained"] for r in found}
    assert np.allclose([shares[c + 1] for c in range(7)], values / values.sum(), rtol=1e-9)
    (error,) = {r["identity_error"] for r in found}
    assert 0 <= error < 1e-9


def test_polarisation_is_exact():
    """Covariances from sums of squares alone equal those of fractions, for entries of any size."""
    draw = np.random.default_rng(3)
    for scale in (10, 10**9, 10**17):
        x = [[int(v) for v in row] for row in draw.integers(-scale, scale, size=(23, 4))]
        n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
        centre, rest = [s // n for s in sums], [s % n for s in sums]
        y = [[a - p for a, p in zip(row, centre, strict=True)] for row in x]
        squares = {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y) for i in range(4) for j in range(i, 4)}
        got = op.covariance(squares, rest, n)
        for i in range(4):
            for j in range(4):
                mean = [Fraction(s, n) for s in sums]
                assert got[i, j] == float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n)


def test_sums_of_large_entries(spark):
    """Entries of up to 2^60 in several tasks: squares that no 64 bits hold are added exactly."""
    rows = [(i, [(-1.0) ** i * 2.0**53, 2.0**40 * i, 1.0 * i]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    x = [[int(c * 64) + 1_000_000 for c in v] for _, v in rows]
    found = op.usable(frame)
    sums = op._sums(found, 3)
    assert sums == [sum(c) for c in zip(*x, strict=True)]
    centre = np.array([s // 40 for s in sums], np.int64)
    squares = op._squares(found, centre)
    y = [[a - int(p) for a, p in zip(row, centre, strict=True)] for row in x]
    assert squares == {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y) for i in range(3) for j in range(i, 3)}
    top = max(r["deviation"] for r in op.whitened(frame).collect())
    assert top == (1 << 63) - 1


def test_no_more_components_than_directions(spark):
    """A dimension that repeats another one or does not vary has no component of its own; at most the asked number come."""
    rows = [(i, [*v, v[0], 0.25]) for i, v in enumerate(_vectors(60, 3, 5))]
    found = op.whitened(_frame(spark, rows)).collect()
    assert {r["component"] for r in found} == {1, 2, 3} and found[0]["identity_error"] < 1e-9
    assert {r["component"] for r in op.whitened(_frame(spark, rows), 2).collect()} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    found = op.whitened(_frame(spark, rows))
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
