"""Skew-proof building blocks: ordered scans inside groups of any size, and joins with hot keys.

A plain ``Window.partitionBy(group)`` sends a whole group to one task.  When the largest group is
too big for that, ``scan`` range-partitions the rows by (group, order) into evenly sized cells, scans
each cell on its own, and carries the running value of a group over cell borders with a table of one
row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import materialize

# Largest group that one task may hold: a few hundred MB of narrow rows.
HOT_GROUP_ROWS = 2_000_000
# Largest table that is sent to every executor, in rows of a few dozen bytes.
BROADCAST_ROWS = 500_000


# Rows of a few hundred bytes that one task sorts or groups: more rows make more tasks, not larger ones.
TASK_ROWS = 500_000
# Cells that groups are counted by before any is counted alone.
SIZE_CELLS = 1 << 16


def group_sizes(df: DataFrame, group: Sequence[str], limit: int) -> tuple[int, int]:
    """Rows of the largest group, or a bound of it that is within ``limit``, and of all groups.

    Groups are counted by hash into a fixed number of cells first, so that tasks hold few counts however many groups there are.
    Where no cell is above ``limit``, no group is; else the groups themselves are counted.
    """
    cell = F.pmod(F.xxhash64(*group), F.lit(SIZE_CELLS)) if group else F.lit(0)
    for keys in ([cell.alias("_cell")], group):
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        largest, total = counted.agg(F.max("_n"), F.sum("_n")).first()
        if (largest or 0) <= limit:
            break
    return largest or 0, total or 0


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of so many rows with those of a key in one task and about ``TASK_ROWS`` in each.

    Few rows are left to the usual number of tasks, which then hold no more than that.
    """
    spark = df.sparkSession
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not keys or rows <= TASK_ROWS * usual:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def _running(kind: str, column: str | None, window, full) -> Column:
    if kind == "rank":
        return F.row_number().over(window).cast("bigint")
    if kind == "sum":
        return F.sum(column).over(full)
    if kind == "max":
        return F.max(column).over(full)
    if kind == "last":
        return F.last(column, ignorenulls=True).over(full)
    raise ValueError(f"unknown scan kind: {kind}")


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("rank", "sum"):
        return F.when(local.isNull(), carry).otherwise(local + F.coalesce(carry, F.lit(0)))
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, str | None]],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Running values per group in ascending ``order``, which must be a total order.

    ``outputs`` maps a new column to (kind, input): ``rank`` (1-based), ``sum``, ``max`` or ``last``
    (latest non-null value), each over the rows up to and including the current one.
    """
    largest, total = group_sizes(df, group, hot_rows) if hot_rows else (1, df.count())
    if largest <= hot_rows:
        keys = list(group) or [F.lit(0)]
        window = Window.partitionBy(*keys).orderBy(*order)
        full = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return dealt(df, group, total).withColumns({n: _running(k, c, window, full) for n, (k, c) in outputs.items()})
    return _scan_cells(df, group, order, outputs, total)


def _scan_cells(df, group, order, outputs, total) -> DataFrame:
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // HOT_GROUP_ROWS))
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    ranged = df.repartitionByRange(tasks, *group, *order).withColumn("_cell", F.spark_partition_id())
    ranged = ranged.repartition(tasks, "_cell")

    # Both windows sort by (cell, group, order), so the rows of a cell are sorted once.
    window = Window.partitionBy("_cell", *group).orderBy(*order)
    full = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_cell = Window.partitionBy("_cell").orderBy(*group, *order)
    scanned = ranged.withColumns(
        {
            **{n: _running(k, c, window, full) for n, (k, c) in outputs.items()},
            "_opens": F.row_number().over(in_cell) == 1,
            "_closes": F.lead(F.lit(1)).over(in_cell).isNull(),
        }
    )
    scanned = materialize(scanned, "cells")

    # One row per cell: a table as long as the number of tasks.
    opens = scanned.filter("_opens").select("_cell", key.alias("_first"))
    closes = scanned.filter("_closes").select("_cell", key.alias("_last"), *[F.col(n).alias(f"_t_{n}") for n in outputs])
    by_last = Window.partitionBy("_last").orderBy("_cell")
    upto = by_last.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_cell = Window.orderBy("_cell")
    run = opens.join(closes, "_cell")
    for name, (kind, _) in outputs.items():
        total = F.col(f"_t_{name}")
        if kind == "last":
            folded = F.last(total, ignorenulls=True).over(upto)
        else:
            folded = (F.max if kind == "max" else F.sum)(total).over(upto)
        run = run.withColumn(f"_r_{name}", folded)
    run = run.withColumn("_prev", F.lag("_last").over(by_cell))
    carry = run.select(
        "_cell",
        "_first",
        *[
            F.when(F.col("_prev").eqNullSafe(F.col("_first")), F.lag(f"_r_{n}").over(by_cell)).alias(f"_c_{n}")
            for n in outputs
        ],
    )
    joined = scanned.join(F.broadcast(carry), "_cell")
    first = key.eqNullSafe(F.col("_first"))
    return joined.withColumns(
        {
            n: F.when(first, _combine(k, F.col(n), F.col(f"_c_{n}"))).otherwise(F.col(n))
            for n, (k, _) in outputs.items()
        }
    ).select(*df.columns, *outputs)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and the tasks to spread each over (``_salts``).

    There are at most rows / hot_rows such keys.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def hot_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    identity: Sequence[str],
    how: str = "left",
    residual: Column | None = None,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Join a large side with a side that holds few rows per key, when keys may be hot.

    Rows of a hot key are spread by a hash of ``identity`` (columns that tell the rows apart), one task per
    ``hot_rows`` of them, and the lookup rows of just those keys are repeated.  Without hot keys this is the plain join;
    ``hot_rows=None`` says that the caller has already seen there are none.
    """
    keys = list(keys)
    hot = None if hot_rows is None else hot_keys(fact, keys, hot_rows)
    on, left, right = keys, fact, lookup
    if hot is not None and not hot.isEmpty():
        hot = F.broadcast(materialize(hot, "hot"))
        salts = F.coalesce("_salts", F.lit(1))
        salt = F.pmod(F.xxhash64(*identity), salts).cast("int")
        left = fact.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
        spread = F.sequence(F.lit(0), salts - 1)
        right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(spread)).drop("_salts")
        on = [*keys, "_salt"]
    if residual is None:
        joined = left.join(right, on, how)
    else:
        renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
        condition = residual
        for c in on:
            condition = condition & (F.col(c) == F.col(f"_k_{c}"))
        joined = left.join(renamed, condition, how).drop(*[f"_k_{c}" for c in on])
    return joined.drop("_salt")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is known to hold at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(fact, lookup, keys, identity, how="left", residual=None) -> DataFrame:
    """Broadcast the lookup when its row count is checked to be small, else ``hot_join``."""
    if small_enough(lookup):
        renamed = lookup.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in lookup.columns])
        condition = residual if residual is not None else F.lit(True)
        for c in keys:
            condition = condition & (F.col(c) == F.col(f"_k_{c}"))
        return fact.join(F.broadcast(renamed), condition, how).drop(*[f"_k_{c}" for c in keys])
    return hot_join(fact, lookup, keys, identity, how, residual)
