"""Approximate nearest neighbours by multi-index hashing.

Vectors are extended by one coordinate so that the largest inner product is the smallest angle, rotated by a learned rotation (iterative
quantisation on a bounded sample), and turned into 64-bit codes.  A code is cut into four substrings and indexed by each.
By the pigeonhole principle a code within Hamming radius r of a query agrees with it, in at least one substring, to within r / 4
bits (r // 4, and one bit less for the substrings beyond the remainder), so probing those buckets retrieves every code
within r; the retrieved vectors are reranked by inner products in double precision.  The radius is measured: it is the one
that holds ``TARGET`` of the true neighbours of a sample of queries, found by brute force over all rows.  Queries whose ball holds
too few codes are searched again with larger radii, at last with all codes, until they have their number or all candidates.

Queries and rows meet in blocks: rows are dealt into shards of bounded size, queries into blocks, and each task indexes one
shard.  Only the best of each shard leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from traceloom.llm.ship import ship
from traceloom.llm.tables import checked
from traceloom.session import materialize

BITS = 64
PARTS = 4  # substrings of 16 bits
NEAREST = 20
EVERY = 20  # a row whose id is divisible by this is a query
LEARN = 16_384  # vectors the rotation is learnt from, at most
MEASURE = 256  # queries the radius is measured on, at most
TARGET = 0.97
SHARD = 8_192  # rows indexed by one task, on average
BLOCK = 8_192  # queries that meet a shard together, on average
ROUNDS = 30
WIDER = 4  # bits added to the radius for queries that found too few; doubled each time

_POP16 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_POP16 = (_POP16[:, None] + _POP16[None, :]).reshape(-1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id and embedding neither null nor zero, all components finite, of the most frequent length.

    Vectors of another length have no inner product with them; of equally frequent lengths the smaller counts.
    """
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(whole & finite)
    return rows


def _learn(sample: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimensions + 1, BITS) of the extended vectors, by iterative quantisation."""
    x = extended(sample, largest)
    centre = x.mean(axis=0)
    x = x - centre
    _, directions = np.linalg.eigh(x.T @ x)
    columns = []
    random = np.random.default_rng(20260101)
    while sum(c.shape[1] for c in columns) < BITS:
        kept = directions[:, ::-1][:, : min(BITS - sum(c.shape[1] for c in columns), x.shape[1])]
        turn = np.linalg.qr(random.normal(size=(kept.shape[1], kept.shape[1])))[0]
        reduced = x @ kept
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced)
            turn = (u @ v).T
        columns.append(kept @ turn)
    return centre, np.hstack(columns)


def extended(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest]) / largest


def _codes(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((x - centre) @ projection) >= 0
    return np.packbits(bits, axis=1).view(np.uint64).reshape(-1)


def radii(radius: int) -> list[int]:
    """Bits by which each substring may differ, so that every code within ``radius`` is retrieved (-1: not probed)."""
    each, rest = divmod(radius, PARTS)
    return [each if i <= rest else each - 1 for i in range(PARTS)]


class Index:
    """One shard: codes by each substring, and the vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.x, self.codes = ids, x, codes
        parts = codes.view(np.uint16).reshape(-1, PARTS)
        self.tables = []
        for i in range(PARTS):
            order = np.argsort(parts[:, i], kind="stable")
            values, counts = np.unique(parts[:, i], return_counts=True)
            self.tables.append((values, counts, order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius``."""
        mine = np.array([code], np.uint64).view(np.uint16)
        marked = np.zeros(len(self.codes), bool)
        for (values, counts, order), own, bits in zip(self.tables, mine, radii(radius), strict=True):
            if bits >= 0:
                marked[order[np.repeat(_POP16[values ^ own] <= bits, counts)]] = True
        found = np.flatnonzero(marked)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]

    def nearest(self, query_id: int, q: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.within(code, radius)
        found = found[self.ids[found] != query_id]
        # One product per row and no blocked sums: a score does not depend on which rows stand beside it.
        score = np.einsum("ij,j->i", self.x[found], q)
        if len(found) > k:
            best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            found, score = found[best], score[best]
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[order]], score[order], np.bitwise_count(self.codes[found[order]] ^ code)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


_FOUND = "query_id bigint, vec_id bigint, score double, distance int"


def _meet(rows: DataFrame, queries: DataFrame, model: tuple, radius: int, shards: int, blocks: int, k: int) -> DataFrame:
    """The ``k`` best of each shard within ``radius`` of each query."""
    centre, projection, largest = model

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x = _matrix(left["embedding"])
            index = Index(left["vec_id"].to_numpy(np.int64), x, _codes(extended(x, largest), centre, projection))
            q = _matrix(right["query"])
            norms = np.sqrt((q * q).sum(axis=1, keepdims=True))
            codes = _codes(np.column_stack([q / norms, np.zeros(len(q))]), centre, projection)
            for query_id, vector, code in zip(right["query_id"].to_numpy(np.int64), q, codes, strict=True):
                ids, score, distance = index.nearest(query_id, vector, code, radius, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": score, "distance": distance.astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "distance": []}).astype({"query_id": "int64", "vec_id": "int64", "distance": "int32"})

    row = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(shards))).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    query = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).alias("to_block"))
    query = query.withColumn("to_shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    return row.groupBy("shard", "block").cogroup(query.groupBy("to_shard", "to_block")).applyInPandas(search, _FOUND)


def _sought(queries: DataFrame, n: int, k: int) -> DataFrame:
    """query_id, wanted: the rows each query can have, ``k`` or all of the ``n`` rows but those with its own id."""
    # A query's own rows are queries themselves.
    own = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("own"))
    return materialize(own.select("query_id", F.least(F.lit(k), F.lit(n) - F.col("own")).alias("wanted")), "sought")


def _short(sought: DataFrame, found: DataFrame) -> DataFrame:
    """query_id of the queries that found fewer rows than they can have."""
    had = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("had"))
    return sought.join(had, "query_id", "left").filter(F.coalesce("had", F.lit(0)) < F.col("wanted")).select("query_id")


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by inner product, ties to the smaller vec_id.

    Queries are the distinct usable rows whose vec_id is divisible by ``every``; candidates are all usable rows but those with
    the query's own id.  Fewer usable candidates give fewer rows; no usable rows give none.  A repeated (vec_id, embedding) row counts once.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    form = T.StructType.fromDDL("query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return spark.createDataFrame([], form)
    rows = materialize(rows.filter(F.size("embedding") == sizes["d"]).dropDuplicates(["vec_id", "embedding"]), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    chosen = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(LEARN).select("embedding").collect()
    centre, projection = _learn(np.array([r["embedding"] for r in chosen], np.float64), facts["largest"])
    model = centre, projection, facts["largest"]
    shards, blocks = -(-facts["n"] // SHARD), max(1, -(-facts["q"] // BLOCK))

    probe = queries.orderBy(F.xxhash64(F.lit(4), "vec_id"), "vec_id").limit(MEASURE)
    exact = _meet(rows, materialize(probe, "probe"), model, BITS, shards, 1, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    counted = true.groupBy("distance").count().orderBy("distance").collect()  # at most BITS + 1 rows
    total, radius, seen = sum(c["count"] for c in counted), BITS, 0
    for c in counted:
        seen += c["count"]
        if seen >= TARGET * total:
            radius = c["distance"]
            break

    sought = _sought(queries, facts["n"], k)
    found = materialize(_meet(rows, queries, model, radius, shards, blocks, k), "found")
    wider = WIDER
    while radius < BITS and (n := (short := materialize(_short(sought, found), "short")).count()):
        radius, wider = min(radius + wider, BITS), wider * 2
        again = queries.join(checked(short.withColumnRenamed("query_id", "vec_id")), "vec_id", "left_semi")
        more = _meet(rows, again, model, radius, shards, -(-n // BLOCK), k)
        found = materialize(found.join(checked(short), "query_id", "left_anti").select(*more.columns).union(more), "found")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
