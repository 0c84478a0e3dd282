"""Lines are decoded evenly and once, and only what a query needs of them is written."""

from pyspark.sql import functions as F

from traceloom.operators import heavy
from traceloom.plans.views import Views
from traceloom.sources import raw

SF = "/root/testdata/sf0.001"


def test_frequent_values_read_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(value):
        seen.add(1)
        return value

    rows = spark.range(1000).select(F.lit("x").alias("tool"), F.col("id").alias("line_number"), (F.col("id") % 7).cast("string").alias("v"))
    found = heavy.frequent_values(rows, F.udf(watched, "string").asNondeterministic()("v"), 2)
    assert [(r["value"], r["n"]) for r in found.orderBy("position").collect()] == [("0", 143), ("1", 143)]
    assert seen.value == 1000


def test_lines_of_one_split_are_dealt_to_all_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert Views(spark, SF).events.rdd.getNumPartitions() == 1
        assert Views(spark, SF).raw_lines.rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset(key)


def test_chosen_columns_are_those_of_the_records(spark, monkeypatch):
    v, written = Views(spark, SF), []
    whole = v.records.select("run_id", "line_number", "tier", "non_ascii", "record_class", "src", F.col("attributes")["size"].alias("size"))
    monkeypatch.setattr(raw, "materialize", lambda df, tag, real=raw.materialize: written.append((tag, df.columns)) or real(df, tag))
    few = v.records_of("record_class", "src", F.col("attributes")["size"].alias("size")).select(*whole.columns)
    assert {r[2] for r in few.select("run_id", "line_number", "tier").collect()} >= {"strict_ok", "repairable_latin1", "repairable_escape_quotes", "unrepaired"}
    assert sorted(map(repr, few.collect())) == sorted(map(repr, whole.collect()))
    assert ("chosen", ["file_path", "line_number", "tier", "non_ascii", "valid_utf8", "_text", "record_class", "src", "size"]) in written
