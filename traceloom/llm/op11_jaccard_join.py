"""N-gram Jaccard self-join by T-occurrence search.

A text is the set of its word shingles; texts with equal sets are one item from then on, so a group of copies of any size is one row.
Two sets of a similarity of at least s share at least T = ceil(s * n) shingles of either one's n.

1. One pass makes sizes and digests, and counts shingles in a sketch of fixed size.  The sketch only orders the shingles, the rarer first;
   any order gives the same links, a good one keeps the lists below short.
2. Of the n inverted lists of an item, T - 1 may be set aside as long: whoever shares T shingles is in one of the n - T + 1 others.  Only these,
   its rarest, are listed.  A shingle listed by one item alone links nothing.
3. Each item is compared with the first item of each of its lists: among the n - T + ``SHORT`` rarest of either they must share ``SHORT`` (that
   many of the shared ones are in both), and then enough on full sets.  What is linked is united: a large group of near copies
   becomes one component here, at a cost in proportion to its lists.
4. The other items of each list are cut by size into cells, large ones into blocks that meet in pairs.  A cell first merges the short lists
   of its items: a pair is due in the cell of its first common shingle if it shares ``SHORT`` of the rarest.  Only items with a pair that is due stay,
   and only these bring their full sets.
5. The cell indexes the sets and asks, for each item, for the items that share T shingles (DivideSkip): short lists are merged and those kept that could
   still reach T, long lists are probed for them by binary search, and the similarity is checked on the exact number of common shingles.  Items
   already united are not asked for, so a cell puts out fewer links than it has items.
6. Links are united by a distributed union-find.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import hashing
from traceloom.llm.components import components
from traceloom.llm.ship import ship
from traceloom.session import materialize

WIDTH = 3  # words in a shingle
SIMILAR = (90, 100)  # threshold as a ratio of whole numbers
COUNTERS = 1 << 21  # of the sketch
SHORT = 6  # shared shingles looked for among the rarest before full sets are compared
FAN = 16  # sketches added up by one task
SENT_BYTES = 16 << 20  # of digests that are sent to every task
CELL = 1 << 18  # shingles of a block of a cell, on average
PROBES = 1 << 20  # binary probes made at once
MU = 0.0085  # weight of the longest list in the number of long lists
SLICE = 256  # texts hashed at once


def needed(n, over: int = SIMILAR[0], under: int = SIMILAR[1]):
    """Fewest shingles that a set of ``n`` shares with any similar set; whole numbers or arrays of them."""
    return -(-over * n // under)


def _sets(texts: list) -> Iterator[np.ndarray]:
    return (np.unique(s) for s in hashing.word_shingles(texts, WIDTH))


def _counters(shingles: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> pa.Array:
    return pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())


def _unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held), np.int64)


def _read_sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, list(_sets(part.column(column).to_pylist()))


def _digests(sets: list[np.ndarray]) -> list[int | None]:
    return [hashing.digest(s.tobytes()) if len(s) else None for s in sets]


_SIGNED = "doc_id bigint, n_shingles bigint, item bigint, counts binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and at the end of the task one row with its sketch."""
    counts, names = np.zeros(COUNTERS, np.int64), ["doc_id", "n_shingles", "item", "counts"]
    for part, sets in _read_sets(batches, 1):
        places, times = np.unique(_counters(np.concatenate(sets)), return_counts=True)
        counts[places] += times
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(_digests(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
    nothing = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, _packed(counts)], names=names)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for held in batch.column(0):
            total += _unpacked(held.as_py())
    yield pa.RecordBatch.from_arrays([_packed(total)], names=["counts"])


def _rarity(sketches: DataFrame) -> np.ndarray:
    """Per counter its count, 32 bits at most: sketches are added in a tree, a few of them reach the driver."""
    rows = sketches.count()
    while rows > FAN:
        rows = -(-rows // FAN)
        sketches = materialize(sketches.repartition(rows).mapInArrow(_add, "counts binary"), "sketch")
    total = sum((_unpacked(r["counts"]) for r in sketches.collect()), np.zeros(COUNTERS, np.int64))
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def _lists(values: list[np.ndarray]) -> pa.Array:
    limits = np.cumsum([0] + [len(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64)))


def _prefixes(rarity: np.ndarray):
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # only spares repeats; the table is made distinct afterwards
        for _, sets in _read_sets(batches, 0):
            items, sizes, held = [], [], []
            for item, s in zip(_digests(sets), sets, strict=True):
                if item is None or item in seen:
                    continue
                seen.add(item)
                order = np.lexsort((s, rarity[_counters(s)]))
                items.append(item)
                sizes.append(len(s))
                held.append(s[order[: len(s) - needed(len(s)) + SHORT]])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(sizes, pa.int64()), _lists(held)], names=["item", "n", "prefix"])

    return prefix


def _whole(wanted: np.ndarray | None):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _read_sets(batches, 0):
            items, held = [], []
            for item, s in zip(_digests(sets), sets, strict=True):
                if item is None or item in seen:
                    continue
                if wanted is not None:
                    at = np.searchsorted(wanted, item)
                    if at == len(wanted) or wanted[at] != item:
                        continue
                seen.add(item)
                items.append(item)
                held.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), _lists(held)], names=["item", "shingles"])

    return whole


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, shingles) of the items of the stored table ``wanted``; their digests are sent to the tasks if they are counted to be few."""
    sent = None
    if wanted.count() * 8 <= SENT_BYTES:
        sent = np.sort(np.array([r["item"] for r in wanted.collect()], np.int64))
    sets = texts.mapInArrow(_whole(sent), "item bigint, shingles array<bigint>").dropDuplicates(["item"])
    return materialize(sets if sent is not None else sets.join(wanted, "item", "left_semi"), "sets")


def _similar(common, n, m):
    return SIMILAR[1] * common >= SIMILAR[0] * (n + m - common)


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes and number of common entries of their ``shingles``."""
    left, right = (sets.select(F.col("item").alias(name), F.col("shingles").alias(f"s{name}")) for name in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


class _Index:
    """The inverted lists of the sets of a cell, which stand in order of their size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.limits = np.append(0, np.cumsum(self.sizes))
        _, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.codes, kind="stable")
        self.postings = owner[order]
        self.keys = self.codes[order].astype(np.int64) * len(sets) + self.postings
        self.lengths = np.bincount(self.codes)
        self.starts = np.append(0, np.cumsum(self.lengths))

    def merged(self, codes: np.ndarray) -> np.ndarray:
        """Per item in how many of the lists it is.  The merge is counted per item rather than popped from a heap one by one."""
        lists = [self.postings[self.starts[c] : self.starts[c + 1]] for c in codes]
        return np.bincount(np.concatenate([*lists, self.postings[:0]]), minlength=len(self.sizes))

    def search(self, q: int, asked: np.ndarray) -> np.ndarray:
        """Those of ``asked``, smaller than ``q`` in number and not in size below what can be similar, that are similar to set ``q``."""
        own = self.codes[self.limits[q] : self.limits[q + 1]]
        own = own[self.lengths[own] > 1]
        least = int(needed(self.sizes[q]))
        if len(own) < least:
            return asked[:0]
        own = own[np.argsort(self.lengths[own], kind="stable")]
        longest = int(self.lengths[own[-1]])
        n_long = min(least - 1, int(least / (MU * np.log2(longest) + 1)))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        counts = self.merged(short)
        found = asked[counts[asked] >= least - n_long]
        common = counts[found]
        for at in range(0, len(long), max(1, PROBES // max(len(found), 1))):
            part = long[at : at + max(1, PROBES // max(len(found), 1))]
            probes = part[:, None].astype(np.int64) * len(self.sizes) + found[None, :]
            place = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            common = common + (self.keys[place] == probes).sum(axis=0)
            alive = common + len(long) - at - len(part) >= least
            found, common = found[alive], common[alive]
            if not len(found):
                break
        return found[_similar(common, self.sizes[q], self.sizes[found])]


class _Cell:
    """Items of two blocks of a list (or of one block with itself) in order of their size, with a set each."""

    def __init__(self, cell: pa.Table):
        sizes = cell["n"].to_numpy()
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.items, self.blocks, self.guests = (cell[c].to_numpy()[self.order] for c in ("item", "block", "guest"))
        self.roots = np.unique(cell["root"].to_numpy()[self.order], return_inverse=True)[1]
        self.across = cell["i"][0].as_py() != cell["j"][0].as_py()
        sets = cell["shingles"].combine_chunks()
        self.sets = [sets[int(i)].values.to_numpy() for i in self.order]

    def asked(self, q: int) -> np.ndarray:
        """Items before ``q`` of a size that can be similar, not united with it, that it meets in this cell."""
        asked = np.arange(int(np.searchsorted(self.sizes, needed(self.sizes[q]))), q)
        apart = self.roots[asked] != self.roots[q]
        if self.guests[q]:  # two guests meet in the cell of their own
            apart &= ~self.guests[asked]
        if self.across:
            apart &= self.blocks[asked] != self.blocks[q]
        return asked[apart]


def _due(cell: pa.Table) -> pa.Table:
    """The rows of a cell, less their sets, whose item has a pair that is due here; the sets are prefixes, rarest first."""
    held = _Cell(cell)
    index, token = _Index(held.sets), cell["token"][0].as_py()
    due = np.zeros(len(held.items), bool)
    for q in range(1, len(due)):
        asked = held.asked(q)
        if not len(asked):
            continue
        own = index.codes[index.limits[q] : index.limits[q + 1]]
        earlier = own[: int(np.flatnonzero(held.sets[q] == token)[0])]
        counts = index.merged(own)[asked]
        found = asked[(counts >= np.minimum(SHORT, needed(held.sizes[asked]))) & (index.merged(earlier)[asked] == 0)]
        if len(found):
            due[q] = True
            due[found] = True
    return cell.drop_columns(["shingles"]).take(held.order[due])


def _search_cell(cell: pa.Table) -> pa.Table:
    """Links between the items of a cell that are not united, one per union."""
    held = _Cell(cell)
    index = _Index(held.sets)
    a, b = [], []
    for q in range(1, len(held.items)):
        while len(asked := held.asked(q)) and len(found := index.search(q, asked)):
            # One link for each component that is met.
            _, at = np.unique(held.roots[found], return_index=True)
            for other in found[at]:
                a.append(held.items[q])
                b.append(held.items[other])
                held.roots[held.roots == held.roots[other]] = held.roots[q]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_CELL_KEY = ["token", "band", "i", "j"]


def _links(texts: DataFrame, rarity: np.ndarray, cell: int) -> DataFrame:
    """Links (a, b) that join all similar items."""
    rarest = texts.mapInArrow(_prefixes(rarity), "item bigint, n bigint, prefix array<bigint>").dropDuplicates(["item"])
    rarest = materialize(rarest, "prefixes")
    least = F.call_function("div", SIMILAR[0] * F.col("n") + SIMILAR[1] - 1, F.lit(SIMILAR[1]))
    listed = rarest.select("item", "n", F.explode(F.slice("prefix", 1, (F.col("n") - least + 1).cast("int"))).alias("token"))
    ends = listed.groupBy("token").agg(F.min(F.struct("item", "n")).alias("lead"), F.max("item").alias("last"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    ends = ends.filter("lead.item <> last").select("token", F.col("lead.item").alias("lead"), F.col("lead.n").alias("lead_n"), "size", "total")
    members = materialize(listed.join(materialize(ends, "lists"), "token"), "members")
    close = SIMILAR[1] * F.least("n", "lead_n") >= SIMILAR[0] * F.greatest("n", "lead_n")
    first = members.filter((F.col("item") != F.col("lead")) & close).select(F.col("item").alias("a"), F.col("lead").alias("b"), F.least(F.lit(SHORT), least).alias("enough")).distinct()
    first = _with_both(materialize(first, "pairs"), rarest.select("item", F.col("prefix").alias("shingles")))
    first = materialize(first.filter("common >= enough").select("a", "b"), "pairs")
    # An item is listed in the cell of its own band of sizes and, as a guest, in the next: similar sizes differ by one band at most.
    band = F.floor(F.log(F.col("n")) / (1.0001 * math.log(SIMILAR[1] / SIMILAR[0])))
    dealt = members.filter("size > 2 and item <> lead").select("token", "item", "n", F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))).alias("s"))
    dealt = dealt.select("token", "s.*", "item", "n")
    some = dealt.groupBy("token", "band").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("guest")).alias("own"), F.sum("n").alias("total"))
    some = materialize(some.filter("size > 1 and own > 0").select("token", "band", F.ceil(F.col("total") / cell).alias("blocks")), "cells")
    dealt = materialize(dealt.join(some, ["token", "band"]), "dealt")

    # Full sets are read once, for the pairs and for all that may be due.
    prefixes = rarest.select("item", F.col("prefix").alias("shingles"))
    block = F.pmod(F.xxhash64("item"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    met = dealt.select("token", "band", "item", "n", "guest", block.alias("block"), other)
    met = met.select("token", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "n", "guest", F.col("item").alias("root"))
    due = materialize(met.join(prefixes, "item").groupBy(*_CELL_KEY).applyInArrow(_due, met.schema), "due")
    wanted = first.select(F.col("a").alias("item")).union(first.select("b")).union(due.select("item")).distinct()
    sets = _full_sets(texts, materialize(wanted, "wanted"))
    links = materialize(_with_both(first, sets).filter(_similar(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"), "links")

    rooted = due.drop("root").join(components(links).withColumnRenamed("root", "_root"), "item", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("_root", "item")).drop("_root"), "rooted")
    still = rooted.groupBy(*_CELL_KEY).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select(*_CELL_KEY)
    cells = rooted.join(materialize(still, "open"), _CELL_KEY).join(sets, "item").groupBy(*_CELL_KEY).applyInArrow(_search_cell, "a bigint, b bigint")
    return links.union(materialize(cells, "links"))


def jaccard_join(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); other columns are ignored, whatever their names.

    A null, empty or blank text has no shingles and is linked with nothing; one of fewer words than a shingle has is one shingle.  component_id is the
    smallest non-null doc_id reachable; it is null only where all of a component have a null doc_id.  Rows that repeat a doc_id are rows
    of their own, linked by their texts.  An empty table gives no rows.  No link is missed; two different shingles
    count as one where their 64-bit hashes agree, as two texts do whose digests agree.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = materialize(texts.mapInArrow(_sign, _SIGNED), "signs")
    rarity = _rarity(signs.filter("counts is not null").select("counts"))
    signs = signs.filter("counts is null").select("doc_id", "n_shingles", "item")
    rooted = components(_links(texts.select("text"), rarity, cell))
    named = signs.filter("item is not null").groupBy("item").agg(F.min("doc_id").alias("least")).join(rooted, "item", "left")
    named = named.select("item", "least", F.coalesce("root", "item").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    found = signs.join(named.join(least, "root").select("item", "component"), "item", "left")
    own = F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))
