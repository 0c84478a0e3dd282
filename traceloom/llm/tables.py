"""Reading the given tables, and sending small ones, for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow ids (some dozen bytes each) that may be sent to every executor.
SENT_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(small: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``small`` (a stored table) marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
