"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, BPE.  Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import op2_toxicity, op4_near_dedup, op8_line_dedup, op9_bpe, op10_mixing
from traceloom.llm.queries import tokenizer_path
from traceloom.llm.tables import table
from traceloom.session import materialize, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)  # holds for the stages after it, too
    return op2_toxicity.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents that lose all their lines go."""
    return op8_line_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op4_near_dedup.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op10_mixing.mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and of the decoded text, per document of the mix."""
    return op9_bpe.digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: A trained classifier and the vocabulary cannot be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
