"""Embedding whitening from a covariance by polarisation.

Entries become whole numbers x, so every sum below is exact and does not depend on the order of its rows.

1. One pass sums x per dimension.  The whole part p of each mean is the centre: y = x - p is small, and what is left of the sum, r = S - n * p,
   is known exactly.
2. A second pass sums the squares of y for every dimension, and of y_i + y_j for every pair of dimensions.  With the remainders these are
   n^2 times the exact sums of squared centred values: sum((n*x - S)^2) = n^2 * sum(y^2) - n * r^2.
3. Half the difference between the variance of a sum and the two variances is the covariance: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2.
   The matrix is assembled from whole numbers, rounded once, and goes to ``eigh``.
4. A third pass projects the rows; a fourth measures, on the rows that were written, how far the covariance of the result is from the identity.

Tasks send one row per pair of dimensions, so what reaches the driver is bounded by the square of the dimension, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.ship import ship
from traceloom.session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
ROWS = 4096  # rows worked on at once in a task
LARGEST = 1 << 60  # 64 * c is held inside these bounds, so that x has its 64 bits
_LIMB = 32  # exact sums travel as four limbs of 32 bits, whose sums over all tasks stay inside 64 bits


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose embedding is not null and has no null or non-finite entry, of the most frequent length.

    Vectors of another length have no covariance with them; of equally frequent lengths the smaller counts, empty vectors never.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter((F.size("embedding") > 0) & finite)
    bound = float(LARGEST)
    x = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-bound)), F.lit(bound))).cast("bigint") + F.lit(SHIFT))
    return rows.select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _total(values: np.ndarray, squared: bool) -> list[int]:
    """Exact column sums of whole numbers, or of their squares, as Python numbers."""
    largest = int(np.abs(values).max()) if values.size else 0
    if (largest * largest if squared else largest) * len(values) >= 1 << 62:
        values = values.astype(object)
    return [int(t) for t in (values * values if squared else values).sum(axis=0)]


def _limbs(totals: list[int]) -> list[pa.Array]:
    """Four columns of limbs of (possibly negative) totals; the last one carries the sign."""
    low = [pa.array([(t >> _LIMB * k) & ((1 << _LIMB) - 1) for t in totals], pa.int64()) for k in range(3)]
    return [*low, pa.array([t >> _LIMB * 3 for t in totals], pa.int64())]


_SUMS = "i int, j int, l0 bigint, l1 bigint, l2 bigint, l3 bigint"
_NAMES = ["i", "j", "l0", "l1", "l2", "l3"]


def _exact(sums: DataFrame) -> dict[tuple[int, int], int]:
    """(i, j) -> total over all tasks: at most one row per pair of dimensions."""
    limbs = [F.sum(f"l{k}").alias(f"l{k}") for k in range(4)]
    return {(r["i"], r["j"]): sum(r[f"l{k}"] << _LIMB * k for k in range(4)) for r in sums.groupBy("i", "j").agg(*limbs).collect()}


def _sums(rows: DataFrame, width: int) -> list[int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * width
        for part in _parts(batches):
            totals = [a + b for a, b in zip(totals, _total(_matrix(part, "x", width), False), strict=True)]
        index = pa.array(range(width), pa.int32())
        yield pa.RecordBatch.from_arrays([index, index, *_limbs(totals)], names=_NAMES)

    found = _exact(rows.select("x").mapInArrow(add, _SUMS))
    return [found[i, i] for i in range(width)]


def _squares(rows: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """(i, i): sum of y_i^2; (i, j) with i < j: sum of (y_i + y_j)^2."""
    width = len(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[list[int]] = [[0] * (width - i) for i in range(width)]
        for part in _parts(batches):
            y = _matrix(part, "x", width) - centre
            own = _total(y, True)
            for i in range(width):
                pairs = _total(y[:, i : i + 1] + y[:, i + 1 :], True)
                totals[i] = [a + b for a, b in zip(totals[i], [own[i], *pairs], strict=True)]
        for i in range(width):
            index = [pa.array([i] * (width - i), pa.int32()), pa.array(range(i, width), pa.int32())]
            yield pa.RecordBatch.from_arrays([*index, *_limbs(totals[i])], names=_NAMES)

    return _exact(rows.select("x").mapInArrow(add, _SUMS))


def covariance(squares: dict[tuple[int, int], int], rest: list[int], n: int) -> np.ndarray:
    """The covariance matrix, each entry a whole number over 2 * n^3 rounded once."""
    width = len(rest)

    def spread(i: int, j: int) -> int:
        """n^2 * sum(z^2) - n * sum(z)^2 of z = y_i, or y_i + y_j."""
        return n * n * squares[i, j] - n * (rest[i] + (rest[j] if i != j else 0)) ** 2

    own = [spread(i, i) for i in range(width)]
    out = np.empty((width, width))
    for i in range(width):
        out[i, i] = float(Fraction(own[i], n**3))
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = float(Fraction(spread(i, j) - own[i] - own[j], 2 * n**3))
    return out


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, unit eigenvectors as columns, and shares of the trace; directions without variance are left out."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(float(values[0]), 0.0) * len(values) * 1e-15
    kept = np.flatnonzero(real)[:most]
    values, vectors = values[kept], vectors[:, kept]
    sign = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0) if len(kept) else 1.0
    return values, vectors * sign, values / np.trace(matrix) if len(kept) else values


def _project(rows: DataFrame, n: int, centre: np.ndarray, rest: list[int], turn: np.ndarray) -> DataFrame:
    width, kept = turn.shape
    offset = np.array([r / n for r in rest])
    top = (1 << 63) - 1

    def deviations(y: np.ndarray) -> np.ndarray:
        largest = int(np.abs(y).max()) if y.size else 0
        if (n * (largest + 1)) ** 2 * width < 1 << 63:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)
        exact = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return np.array([min(int(d), top) for d in exact], np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            y = _matrix(part, "x", width) - centre
            white = (y - offset) @ turn
            limits = pa.array(np.arange(0, white.size + 1, kept), pa.int32())
            columns = [part.column("vec_id"), pa.array(deviations(y)), pa.ListArray.from_arrays(limits, pa.array(white.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "white"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation bigint, white array<double>"
    return rows.mapInArrow(project, schema)


def _identity_error(white: DataFrame, n: int, kept: int) -> float:
    """Largest absolute entry of the covariance of ``white`` (a stored table) minus the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((kept, kept)), np.zeros(kept)
        for part in _parts(batches):
            w = _matrix(part, "white", kept)
            products += w.T @ w
            sums += w.sum(axis=0)
        index = np.arange(kept, dtype=np.int32)
        for i in range(kept):
            columns = [pa.array([i] * kept, pa.int32()), pa.array(index), pa.array(products[i]), pa.array(np.full(kept, sums[i]))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "product", "total"])

    parts = white.select("white").mapInArrow(add, "i int, j int, product double, total double")
    products, means = np.zeros((kept, kept)), np.zeros(kept)
    for r in parts.groupBy("i", "j").agg(F.sum("product").alias("p"), F.sum("total").alias("t")).collect():
        products[r["i"], r["j"]] = r["p"] / n
        means[r["i"]] = r["t"] / n
    return float(np.abs(products - np.outer(means, means) - np.eye(kept)).max())


def _nothing(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of the rows of ``vectors`` (vec_id, embedding).

    Other columns are ignored.  Rows without a usable vector (``usable``) go; a null vec_id stays null and rows that repeat a vec_id are
    rows of their own, in the fit as in the result.  There are as many components as the vectors have directions with variance, ``most``
    at most: a table with no two different vectors, or none at all, gives no rows.  A deviation beyond 64 bits, which takes entries
    of many millions, is given as the largest such number.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(usable(vectors), "whole")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if lengths is None:
        return _nothing(spark, kind)
    width, n = lengths["width"], lengths["n"]
    rows = rows.filter(F.size("x") == width)
    sums = _sums(rows, width)
    centre, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    values, axes, shares = components(covariance(_squares(rows, centre), rest, n), most)
    if not len(values):
        return _nothing(spark, kind)
    white = materialize(_project(rows, n, centre, rest, axes / np.sqrt(values)), "white")
    error = _identity_error(white, n, len(values))
    explained = F.array(*[F.lit(float(s)) for s in shares])
    listed = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return listed.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
