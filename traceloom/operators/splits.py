"""Scenario-based train/val/test splits.  A scenario lands in the same split for all tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.names import SPLITS
from traceloom.operators.ordered import lookup_join, scan


def split_counts(total: int, train_ratio: float = 0.7, val_ratio: float = 0.15) -> tuple[int, int, int]:
    """Sizes of train, val and test.  Test keeps at least one of three or more scenarios: what is too much
    comes off the larger of train and val until they are level, then off both in turn, train first."""
    if total < 3:
        return (min(max(total, 0), 1), 0, int(total == 2))
    train, val = max(1, int(total * train_ratio)), max(1, int(total * val_ratio))
    excess = max(0, train + val + 1 - total)
    level = min(excess, abs(train - val))
    in_turn = excess - level
    if train > val:
        train -= level
    else:
        val -= level
    train -= (in_turn + 1) // 2
    val -= in_turn // 2
    return train, val, total - train - val


def attack_counts(total: int, with_validation: bool, val_ratio: float, test_ratio: float) -> tuple[int, int]:
    """Attack scenarios in val and test; all go to test unless validation asks for a share of two or more."""
    if not with_validation or total <= 1:
        return 0, total
    share = val_ratio / (val_ratio + test_ratio) if val_ratio + test_ratio else 0.5
    val = min(max(1, int(total * share)), total - 1)
    return val, total - val


def split_scenarios(
    runs: DataFrame,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    with_validation: bool = False,
) -> DataFrame:
    """(benign, scenario, position, split): sorted distinct scenarios cut by position."""
    benign = (F.col("kind") == "benign").alias("benign")
    distinct = runs.filter(F.trim("scenario") != "").select(benign, "scenario").distinct()
    ranked = scan(distinct, ["benign"], ["scenario"], {"position": ("rank", None)})
    totals = {r["benign"]: r["n"] for r in distinct.groupBy("benign").agg(F.count(F.lit(1)).alias("n")).collect()}
    train, val, _ = split_counts(totals.get(True, 0), train_ratio, val_ratio)
    attack_val, _ = attack_counts(totals.get(False, 0), with_validation, val_ratio, test_ratio)
    position = F.col("position")
    split = (
        F.when(F.col("benign") & (position <= train), "train")
        .when(F.col("benign") & (position <= train + val), "val")
        .when(~F.col("benign") & (position <= attack_val), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split)


def split_runs(runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Runs with their split; runs of unlisted scenarios drop out."""
    keyed = runs.withColumn("benign", F.col("kind") == "benign")
    lookup = scenarios.select("benign", "scenario", "split")
    return lookup_join(keyed, lookup, ["benign", "scenario"], ["run_id"], "inner").drop("benign")


def split_summary(assigned: DataFrame) -> DataFrame:
    """Runs, scenarios and kinds per tool and split, with a row for every split of a tool."""
    tools = assigned.select("tool").distinct()
    splits = F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split")
    counted = assigned.groupBy("tool", "split").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_distinct("scenario").alias("scenario_count"),
        F.sum((F.col("kind") == "benign").cast("int")).alias("benign_runs"),
        F.sum((F.col("kind") != "benign").cast("int")).alias("attack_runs"),
    )
    numbers = ("run_count", "scenario_count", "benign_runs", "attack_runs")
    return tools.select("tool", splits).join(counted, ["tool", "split"], "left").select(
        "tool", "split", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers]
    )


def ordered_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("tool", "kind", "scenario", "run_id")
