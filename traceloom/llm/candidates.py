"""Similar pairs of signed items: banding, Bayesian pruning, and buckets that are never written out as all their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.components import components
from traceloom.session import materialize

BATCH = 16  # minima compared before each decision
MISS = 1e-6  # probability, over all batches together, of dropping a pair at the threshold
BLOCK = 512  # items of a bucket that meet another such block in one task
CELL = 1 << 18  # and shingles that they have together, on average


def _looks(count: int, batch: int) -> list[int]:
    return [*range(batch, count, batch), count]


def _posterior_bound(count: int, batch: int, level: float, similar: float) -> list[int]:
    """Per batch, the number of equal minima below which the posterior weight of a similarity at or above ``similar`` is under ``level``.

    With a uniform prior, m equal minima of n leave a Beta(m + 1, n - m + 1) posterior, whose weight at or above t is
    the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in _looks(count, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if total >= level:
                break
            m += 1
        out.append(m)
    return out


def missed(least: list[int], count: int, batch: int = BATCH, similar: float = 0.75) -> float:
    """Probability that any of the batches drops a pair whose minima are equal with chance ``similar``: first passages, summed."""
    alive, lost, before = np.ones(1), 0.0, 0
    for n, enough in zip(_looks(count, batch), least, strict=True):
        new = n - before
        alive = np.convolve(alive, [comb(new, m) * similar**m * (1 - similar) ** (new - m) for m in range(new + 1)])
        lost += float(alive[:enough].sum())
        alive[:enough] = 0
        before = n
    return lost


def least_matches(count: int, batch: int = BATCH, miss: float = MISS, similar: float = 0.75) -> list[int]:
    """Per batch, the number of equal minima below which a pair is dropped: all batches together drop a pair at ``similar`` with at most ``miss``.

    Every batch is another chance to drop it, so the posterior level of a single one is halved until the sum holds.
    """
    level = miss
    while missed(least := _posterior_bound(count, batch, level, similar), count, batch, similar) > miss:
        level /= 2
    return least


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _survivors(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions of the pairs (x[i], y[i]) of rows of ``a`` and ``b`` that no batch drops."""
    alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for turn, enough in enumerate(least):
        part = slice(turn * BATCH, (turn + 1) * BATCH)
        equal = equal + (a[x[alive], part] == b[y[alive], part]).sum(axis=1)
        keep = equal >= enough
        alive, equal = alive[keep], equal[keep]
    return alive


def _prune(least: list[int]):
    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own = np.arange(len(frame))
                yield frame.iloc[_survivors(_signatures(frame["sa"]), _signatures(frame["sb"]), own, own, least)][["a", "b"]]

    return prune


class _Bucket:
    """Items of two blocks of a bucket, or of one block with itself."""

    def __init__(self, cell: pa.Table, least: list[int]):
        self.order = np.argsort(cell["item"].to_numpy())
        self.items, self.blocks = cell["item"].to_numpy()[self.order], cell["block"].to_numpy()[self.order]
        self.roots = np.unique(cell["root"].to_numpy()[self.order], return_inverse=True)[1]
        keys = cell["keys"].combine_chunks()
        self.keys = keys.flatten().to_numpy().reshape(len(keys), -1)[self.order]
        self.sign = np.frombuffer(b"".join(cell["signature"].to_pylist()), np.uint8).reshape(len(keys), -1)[self.order]
        self.band = int(np.flatnonzero(self.keys[0] == cell["key"][0].as_py())[0])
        self.across = cell["i"][0].as_py() != cell["j"][0].as_py()
        self.least = least

    def likely(self, q: int) -> np.ndarray:
        """Items before ``q`` that it is not united with, shares no earlier band with, and that no batch drops."""
        asked = np.flatnonzero(self.roots[:q] != self.roots[q])
        if self.across:
            asked = asked[self.blocks[asked] != self.blocks[q]]
        if self.band:
            asked = asked[(self.keys[asked, : self.band] != self.keys[q, : self.band]).all(axis=1)]
        return asked[_survivors(self.sign, self.sign, np.full(len(asked), q), asked, self.least)]


def _due(least: list[int]):
    def due(cell: pa.Table) -> pa.Table:
        """The rows of items with a pair that is to be verified here."""
        held = _Bucket(cell, least)
        wanted = np.zeros(len(held.items), bool)
        for q in range(1, len(wanted)):
            found = held.likely(q)
            if len(found):
                wanted[q] = True
                wanted[found] = True
        return cell.take(held.order[wanted])

    return due


def _verified(least: list[int], similar: tuple[int, int]):
    over, under = similar

    def verified(cell: pa.Table) -> pa.Table:
        """Links between items of a bucket that are similar on full sets, one for each union of two components."""
        held = _Bucket(cell, least)
        sets = cell["shingles"].combine_chunks()
        sets = [sets[int(i)].values.to_numpy() for i in held.order]
        a, b = [], []
        for q in range(1, len(sets)):
            for other in held.likely(q):
                x, y = sets[q], sets[other]
                if held.roots[other] == held.roots[q] or under * min(len(x), len(y)) < over * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if under * common >= over * (len(x) + len(y) - common):
                    a.append(held.items[q])
                    b.append(held.items[other])
                    held.roots[held.roots == held.roots[other]] = held.roots[q]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verified


_CELL_KEY = ["key", "i", "j"]


def similar_links(items: DataFrame, count: int, similar: tuple[int, int], sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that join all similar items sharing a band key, without writing out all pairs of a bucket.

    ``items``, a stored table, has item (bigint), n (size of its set), keys (array<bigint>, one per band) and signature (``count`` bytes); ``sets_of``
    brings the full sets (item, shingles) of a stored table of items.

    1. Each item is compared with the first one of its bucket.  What is confirmed on full sets is united; a bucket whose items are united is done.
    2. The items of each open bucket are compared in blocks, batch by batch.  A pair is due in its first common band only; what leaves a
       block is the items that have a pair that is due, not the pairs.
    3. These items bring their full sets, once per block, and the pairs are verified there.  What leaves is one link for each union of two components.
    """
    buckets = items.select("item", "n", F.explode("keys").alias("key"))
    spans = buckets.groupBy("key").agg(F.min("item").alias("lead"), F.max("item").alias("last"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / CELL)).alias("blocks")
    spans = materialize(spans.filter("lead <> last").select("key", "lead", "size", blocks), "leads")
    members = materialize(buckets.drop("n").join(spans, "key"), "members")
    least = least_matches(count)

    signs = items.select("item", "signature")
    pairs = materialize(members.filter("item <> lead").select(F.col("item").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    left, right = signs.select(F.col("item").alias("a"), F.col("signature").alias("sa")), signs.select(F.col("item").alias("b"), F.col("signature").alias("sb"))
    likely = materialize(pairs.join(left, "a").join(right, "b").mapInPandas(_prune(least), "a bigint, b bigint"), "likely")
    sets = sets_of(materialize(likely.select(F.col("a").alias("item")).union(likely.select("b")).distinct(), "wanted"))
    sa, sb = sets.select(F.col("item").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("item").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    enough = similar[1] * common >= similar[0] * (F.size("sa") + F.size("sb") - common)
    links = materialize(likely.join(sa, "a").join(sb, "b").filter(enough).select("a", "b"), "links")

    rooted = members.filter("size > 2 and item <> lead").join(components(links), "item", "left").withColumn("root", F.coalesce("root", "item"))
    rooted = materialize(rooted.select("key", "item", "root", "blocks"), "rooted")
    still = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    dealt = rooted.join(materialize(still, "open"), "key").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "item"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "root")
    met = met.join(items.select("item", "keys", "signature"), "item")
    due = materialize(met.groupBy(*_CELL_KEY).applyInArrow(_due(least), met.schema), "due")
    sets = sets_of(materialize(due.select("item").distinct(), "wanted"))
    found = due.join(sets, "item").groupBy(*_CELL_KEY).applyInArrow(_verified(least, similar), "a bigint, b bigint")
    return links.union(materialize(found, "links"))
