"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its word shingles, a digest of that set, and a MinHash signature.  Texts with equal sets share
   the digest and are one item from then on, so a group of copies of any size is one row.
2. Items sharing a band of the signature are candidates (``candidates.similar_links``: no bucket is written out as all its pairs).
3. Candidates are compared by batches of minima.  After each batch a pair is dropped when the posterior probability
   of a similarity at or above the threshold (uniform prior) is so low that all batches together miss at most ``candidates.MISS``.
4. Survivors are confirmed on the full sets, recomputed from the texts of the items in question, inside the tasks that compare them.
5. Confirmed links are united by a distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import hashing
from traceloom.llm.candidates import similar_links
from traceloom.llm.components import components
from traceloom.llm.full_sets import full_sets
from traceloom.llm.ship import ship
from traceloom.llm.tables import checked
from traceloom.session import materialize

WIDTH = 5  # words in a shingle
SIMILAR = (75, 100)  # threshold as a ratio of whole numbers
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with probability 5e-6
MINIMA = 256  # of which the first BANDS * ROWS make the bands; all are compared

_SIGNED = "n_shingles bigint, item bigint, keys array<bigint>, signature binary"


def _sets(texts) -> Iterator[np.ndarray]:
    return (np.unique(s) for s in hashing.word_shingles(texts, WIDTH))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id with the size, digest and signature of the shingle set; digest null for texts without words."""

    @F.pandas_udf(_SIGNED)
    def sign(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            sizes, items, keys, signatures = [], [], [], []
            for first in range(0, len(texts), 256):
                sets = list(_sets(texts.iloc[first : first + 256]))
                full = [s for s in sets if len(s)]
                minima = hashing.minhashes(full, MINIMA) if full else np.zeros((0, MINIMA), np.uint32)
                bands = iter(hashing.wide_band_keys(minima, BANDS, ROWS))
                low = iter((minima & np.uint32(0xFF)).astype(np.uint8))
                for s in sets:
                    sizes.append(len(s))
                    items.append(hashing.digest(s.tobytes()) if len(s) else None)
                    keys.append(next(bands) if len(s) else None)
                    signatures.append(next(low).tobytes() if len(s) else None)
            yield pd.DataFrame({"n_shingles": sizes, "item": pd.array(items, "Int64"), "keys": keys, "signature": signatures})

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id, text; others are ignored).

    A null, empty or blank text has no shingles and is linked with nothing.  component_id is the smallest non-null doc_id reachable; it is
    null only where all of a component have a null doc_id, and such rows are kept.  Rows that repeat a doc_id with the same text say the same.
    """
    return _marked(docs).drop("item")


def _marked(docs: DataFrame) -> DataFrame:
    """``near_dedup`` with item, the digest of the shingle set."""
    ship(docs.sparkSession)
    signs = materialize(signed(docs.select("doc_id", "text")), "signs")
    items = signs.filter("item is not null").groupBy("item").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("signature").alias("signature")
    )
    items = materialize(items, "items")
    rooted = components(similar_links(items, MINIMA, SIMILAR, lambda wanted: full_sets(docs.select("text"), wanted, WIDTH)))
    named = rooted.join(items.select("item", "doc_id"), "item")
    least_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(least_id, "root").select("item", "component_id"), "named")
    alone = items.join(named.select("item"), "item", "left_anti").select("item", F.col("doc_id").alias("component_id"))
    wide = signs.select("doc_id", "n_shingles", "item").join(named.union(alone), "item", "left")
    root = F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return wide.select("doc_id", "n_shingles", "item", root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def _digest(texts: pd.Series) -> pd.Series:
    return pd.Series([hashing.digest(s.tobytes()) if len(s) else None for s in _sets(texts)], dtype="Int64")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that are not kept.

    A row is named by its doc_id, null included, and its set: of rows that repeat a doc_id only those with a set that is not kept go.
    """
    gone = _marked(docs).filter("not kept").select(F.col("doc_id").alias("_gone_doc"), F.col("item").alias("_gone_item")).distinct()
    gone = checked(materialize(gone, "gone"))
    digest = F.pandas_udf(_digest, "bigint")
    same = F.col("doc_id").eqNullSafe(F.col("_gone_doc")) & (F.col("_item") == F.col("_gone_item"))
    return docs.withColumn("_item", digest("text")).join(gone, same, "left_anti").select(*docs.columns)
