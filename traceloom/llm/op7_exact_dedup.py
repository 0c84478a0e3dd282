"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Each stage keeps only the groups that still have several rows, so full hashes are taken of texts that agree in length and beginning
with another.  Groups are counted by partial aggregates, so a group of copies of any size is one row per task in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.tables import checked
from traceloom.session import materialize

PREFIX = 256  # characters of the beginning
_BLANK = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANK, "")


def _repeated(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), tag)


def exact_dedup(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_hash for every row of ``docs``.

    Of equal texts the row with the most code points in the original text, then the smallest doc_id (null last), stays.
    Rows that repeat the doc_id and length of the one that stays can't be told from it and are marked kept too.
    text_hash is the SHA-256 of the normalised text, null where the text is known to be unique without it unless ``hash_all``.
    """
    text = normalised(F.col("text"))
    lengths = docs.select(F.length(text).alias("len"))
    same_length = checked(_repeated(lengths, ["len"], "lengths"))

    begun = docs.select(F.length(text).alias("len"), text.alias("norm")).join(same_length, "len")
    begun = begun.select("len", F.xxhash64(F.substring("norm", 1, PREFIX)).alias("begin"))
    same_begin = checked(_repeated(begun, ["len", "begin"], "begins").withColumn("read", F.lit(True)))

    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("full"), F.length(text).alias("len"), text.alias("norm"))
    rows = rows.withColumn("begin", F.xxhash64(F.substring("norm", 1, PREFIX))).join(same_begin, ["len", "begin"], "left")
    whole = F.sha2("norm", 256)
    hashed = rows.select("doc_id", "full", "len", F.coalesce("read", F.lit(False)).alias("read"), (whole if hash_all else F.when(F.col("read"), whole)).alias("text_hash"))
    hashed = materialize(hashed, "hashes")

    best = F.max(F.struct("full", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("least"))).alias("best")
    groups = hashed.filter("read").groupBy("len", "text_hash").agg(F.count(F.lit(1)).alias("n"), best).filter("n > 1")
    groups = groups.select(F.col("len").alias("_len"), F.col("text_hash").alias("_hash"), "n", F.col("best.full").alias("top"), (-F.col("best.least")).alias("keep"))
    same = (F.col("len") == F.col("_len")) & (F.col("text_hash") == F.col("_hash"))
    joined = hashed.join(checked(materialize(groups, "groups")), same, "left")
    alone = F.col("n").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("full") == F.col("top")))
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), kept.alias("kept"), "text_hash")
