"""Ranked lexical search, a term at a time with limited accumulators.

1. The distinct terms of all items are gathered; items are searched in groups whose terms take at most ``GROUP_BYTES``, so what is sent
   to the tasks is bounded whatever the number of items.  Every group meets all documents.
2. One pass over the whole texts stores, per document, its number of terms and its postings: the items' terms it holds and how often.
   Number of documents, of terms, and document frequencies are aggregates of that table.
3. The table is searched in blocks of documents, many in a task.  In a block each item takes its terms rarest first and adds their
   weights to accumulators.  Before each term the bound of what the terms still to come can add (their largest contributions in the block) is
   compared with the k-th best partial score: of the block, or the k-th best score of the task's earlier blocks if that is higher.  Once the
   bound is lower, no document without an accumulator can be among the best, so none is created any more; documents whose
   accumulator and the bound together cannot reach the k-th score are let go, and the survivors are updated exactly to the end.
4. Each task gives out its best k per item; a window that limits per partition before the shuffle ranks them.

All scores are whole numbers, so a rerun of a lost task gives the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.ship import ship
from traceloom.session import materialize

BEST = 50
GROUP_BYTES = 16 << 20  # of the distinct terms of the items searched together
SLICE = 1024  # texts split at once

#: Bytes of terms, A-Z lower-cased; all others are blanks.  Bytes of other than ASCII characters belong to terms.
_CLEAR = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAR).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each; rows that repeat an item_id (null too) add their terms to it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                terms = [sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(text)}) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(split, "item_id bigint, terms array<string>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), and the codes of the terms in ``codes`` with their occurrences."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, limits, held, times = [], [0], [], []
                for text in part.column(1).to_pylist():
                    terms = terms_of(text)
                    counts = Counter([c for t in terms if (c := codes.get(t)) is not None])
                    n.append(len(terms))
                    held.extend(counts.keys())
                    times.extend(counts.values())
                    limits.append(len(held))
                lists = [pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(x, kind)) for x, kind in ((held, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "codes", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(index, "doc_id bigint, n bigint, codes array<int>, times array<bigint>")


def _best(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher score, then smaller id, ids that are null last."""
    return np.lexsort((ids, unnamed, -scores))[:k]


class _Block:
    """The inverted lists of a block of documents: per code its documents and their contributions before weighting."""

    def __init__(self, batch: pa.RecordBatch, documents: int, terms: int):
        ids, self.size = batch.column(0), batch.num_rows
        self.unnamed = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        if self.size and int(n.max()) * documents * 50 >= 1 << 63:
            m = np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
        else:
            m = 50 + 50 * n * documents // max(terms, 1)
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        times = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(self.size), lengths)
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.limits = np.append(starts, len(codes))
        self.docs = at[order]
        self.parts = (10**9 * times // (1000 * times + 20 * m[at]))[order]
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else np.empty(0, np.int64)

    def best(self, wanted: np.ndarray, weights: np.ndarray, k: int, floor_: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best of scores of at least ``floor_``, for terms given rarest first."""
        place = np.searchsorted(self.codes, wanted)
        here = place < len(self.codes)
        here[here] = self.codes[place[here]] == wanted[here]
        place, weights = place[here], weights[here]
        bounds = np.append(np.cumsum((self.most[place] * weights)[::-1])[::-1], 0)
        total = np.zeros(self.size, np.int64)
        creating, alive = True, None
        for turn, (p, w) in enumerate(zip(place, weights, strict=True)):
            if creating:
                held = total[total > 0]
                reach = max(floor_, int(np.partition(held, len(held) - k)[len(held) - k]) if len(held) >= k else 0)
                if bounds[turn] < reach:
                    creating, alive = False, (total > 0) & (total + bounds[turn] >= reach)
            docs, parts = self.docs[self.limits[p] : self.limits[p + 1]], self.parts[self.limits[p] : self.limits[p + 1]]
            if not creating:
                keep = alive[docs]
                docs, parts = docs[keep], parts[keep]
            total[docs] += w * parts
        found = np.flatnonzero((total >= max(floor_, 1)) if alive is None else (total >= max(floor_, 1)) & alive)
        if len(found) > k:
            scores = total[found]
            found = found[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
        return found, total[found]


def _search(items: list[tuple[int | None, np.ndarray, np.ndarray]], documents: int, terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        held = [empty for _ in items]
        for batch in batches:
            block = _Block(batch, documents, terms)
            for i, (_, wanted, weights) in enumerate(items):
                scores, ids, unnamed = held[i]
                docs, fresh = block.best(wanted, weights, k, int(scores[-1]) if len(scores) >= k else 0)
                if len(docs):
                    scores, ids, unnamed = np.append(scores, fresh), np.append(ids, block.ids[docs]), np.append(unnamed, block.unnamed[docs])
                    kept = _best(scores, ids, unnamed, k)
                    held[i] = scores[kept], ids[kept], unnamed[kept]
        for (item, _, _), (scores, ids, unnamed) in zip(items, held, strict=True):
            if len(scores):
                names = pa.array([item] * len(scores), pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.int64(), mask=unnamed), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return search


def _group(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The best of each task for the items of one group; ``wanted`` is their bounded list of (item_id, term)."""
    pairs = [(r["item_id"], r["term"].encode("utf-8", "surrogatepass")) for r in wanted.collect()]
    names = sorted({term for _, term in pairs})
    codes = {term: i for i, term in enumerate(names)}
    stored = materialize(postings(docs, codes), "postings")
    documents, terms = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(names), np.int64)
    for code, df in stored.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1))).collect():
        frequency[code] = df
    # In doubles, as a ratio of whole numbers; a term of all documents weighs nothing and is left out.
    weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    of_item: dict[int | None, list[int]] = {}
    for item, term in pairs:
        if frequency[codes[term]] and weights[codes[term]]:
            of_item.setdefault(item, []).append(codes[term])
    items = []
    for item, held in of_item.items():
        held = np.array(held, np.int32)
        held = held[np.lexsort((held, frequency[held]))]
        items.append((item, held, weights[held]))
    return stored.mapInArrow(_search(items, documents, terms, k), "item_id bigint, doc_id bigint, score bigint")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = BEST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) for each item (item_id, text), best first.

    Other columns are ignored, whatever their names.  A null or empty text has no terms: as a document it is never found, as an item it finds
    nothing.  Rows that repeat an item_id, null included, are one item with the terms of them all.  Every row of ``docs`` is a document
    of its own: rows that repeat a doc_id take a rank each.  Equal scores are ranked by ascending doc_id, null last.  Empty tables give
    no rows.  Texts are read whole, whatever their length.
    """
    ship(docs.sparkSession)
    wanted = materialize(item_terms(items), "items")
    held = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    groups = max(1, -(-held // group_bytes))
    parts = [_group(docs, wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k) for g in range(groups)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
