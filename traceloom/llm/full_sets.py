"""Whole shingle sets of the items that some step asks for, read from the texts again rather than carried along."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceloom.llm import hashing
from traceloom.session import materialize

SENT_BYTES = 16 << 20  # of digests that are sent to every task
SLICE = 256  # texts hashed at once


def _read(wanted: np.ndarray | None, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # only spares repeats inside a task
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                items, held = [], []
                for shingles in hashing.word_shingles(batch.slice(at, SLICE).column(0).to_pylist(), width):
                    if not len(shingles):
                        continue
                    s = np.unique(shingles)
                    item = hashing.digest(s.tobytes())
                    if wanted is not None:
                        place = np.searchsorted(wanted, item)
                        if place == len(wanted) or wanted[place] != item:
                            continue
                    if item not in seen:
                        seen.add(item)
                        items.append(item)
                        held.append(s)
                limits = pa.array(np.cumsum([0] + [len(s) for s in held]), pa.int32())
                values = pa.array(np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.ListArray.from_arrays(limits, values)], names=["item", "shingles"])

    return read


def full_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(item, shingles), stored, of the items (digests) of the stored table ``wanted``, from a table of texts.

    Digests are sent to the tasks if they are counted to be few; else every text's set meets ``wanted`` in a join.  Rows are named by what they
    hold, so null or repeated ids do not matter, and copies are brought once per task.
    """
    sent = None
    if wanted.count() * 8 <= SENT_BYTES:
        sent = np.sort(np.array([r["item"] for r in wanted.select("item").collect()], np.int64))
    sets = texts.select("text").mapInArrow(_read(sent, width), "item bigint, shingles array<bigint>").dropDuplicates(["item"])
    return materialize(sets if sent is not None else sets.join(wanted.select("item"), "item", "left_semi"), "sets")
