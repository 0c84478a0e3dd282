"""Which runs to build again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 3


def build_plan(discovered: DataFrame, stored: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """Status per discovered run: skipped when stored with this schema version and source, rebuilt when stored
    otherwise, built when new.  ``discovered``: run_id, source_file.  ``stored`` adds schema_version."""
    kept = stored.select(
        "run_id", F.col("source_file").alias("_source"), F.col("schema_version").alias("_version"), F.lit(True).alias("_stored")
    )
    same = (F.col("_version") == schema_version) & (F.col("_source") == F.col("source_file"))
    status = F.when(F.col("_stored").isNull(), "built").when(same, "skipped").otherwise("rebuilt")
    return discovered.join(kept, "run_id", "left").select(*discovered.columns, status.alias("status"))


def build_tally(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))
