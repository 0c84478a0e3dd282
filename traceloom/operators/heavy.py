"""The most frequent values of columns with very many different ones, exactly, without grouping by all of them.

1. Values are counted by two hashes into a fixed number of buckets per group: a summary of bounded size that tasks add up before the shuffle.
   A bucket's count bounds the count of every value in it.
2. The values of the heaviest buckets are counted.  The k-th best of them is a floor: no value below it can be among the k best.
3. Only values whose buckets both reach the floor are counted and ranked.  On skewed data these are few; where nothing stands out they
   are all, and the result is still exact.

If groups are so many that the summary is not small, values are counted as they are.  ``rows`` are read once; the passes read their values as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.names import percentage
from traceloom.operators.ordered import small_enough
from traceloom.session import materialize

BUCKETS = 1 << 14


def _bucket(row: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), F.col("value")), F.lit(buckets)).cast("int")


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line"))


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group; the planner limits each task's rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)


def _in(rows: DataFrame, buckets: DataFrame, by: list[str], row: int) -> DataFrame:
    """Rows whose value falls into one of the buckets of a small table."""
    hit = F.col(f"bucket{row}") == F.col("_bucket")
    for column in by:
        hit = hit & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return rows.join(F.broadcast(buckets.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bucket").alias("_bucket"))), hit, "left_semi")


def summary(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """(by…, row, bucket, n) of rows with their two buckets."""
    both = F.array(*[F.struct(F.lit(r).alias("row"), F.col(f"bucket{r}").alias("bucket")) for r in (1, 2)])
    return rows.select(*by, F.explode(both).alias("b")).groupBy(*by, "b.row", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(rows: DataFrame, value: Column, k: int, by: tuple[str, ...] = ("tool",), buckets: int = BUCKETS) -> DataFrame:
    """by…, value, n, share, first_line, position: the ``k`` most frequent values per group of rows that have a line_number.

    Ties go to the value seen first, then to the smaller value.  A null value is none.
    """
    by = list(by)
    keyed = materialize(rows.select(*by, value.alias("value"), "line_number").filter("value is not null"), "values")
    keyed = keyed.withColumns({f"bucket{r}": _bucket(r, buckets) for r in (1, 2)})
    sketch = materialize(summary(keyed, by, buckets), "summary")
    totals = sketch.filter("row = 1").groupBy(*by).agg(F.sum("n").alias("total"))
    if small_enough(sketch):
        heaviest = _first(sketch.filter("row = 1"), by, [F.desc("n"), "bucket"], k)
        best = _first(_counted(_in(keyed, heaviest, by, 1), by), by, [F.desc("n"), "value"], k)
        floor = best.groupBy(*by).agg(F.min("n").alias("floor"), F.count(F.lit(1)).alias("found"))
        floor = materialize(floor.select(*by, F.when(F.col("found") == k, F.col("floor")).otherwise(1).alias("floor")), "floor")
        reach = sketch.join(F.broadcast(floor.withColumnsRenamed({c: f"_{c}" for c in by})), _same(by), "inner").filter("n >= floor")
        reach = materialize(reach.select(*by, "row", "bucket"), "reach")
        for row in (1, 2):
            keyed = _in(keyed, reach.filter(F.col("row") == row), by, row)
    top = _first(_counted(keyed, by), by, [F.desc("n"), "first_line", "value"], k)
    joined = top.join(totals.withColumnsRenamed({c: f"_{c}" for c in by}), _same(by), "inner")
    return joined.select(*by, "value", "n", percentage(F.col("n"), F.col("total")).alias("share"), "first_line", "position")


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for column in by:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return same
