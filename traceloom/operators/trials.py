"""Experiment trials: log metrics, leaderboards, successive halving, status and final reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.names import fixed_number, rung_number, safe_name
from traceloom.operators.ordered import HOT_GROUP_ROWS, dealt, group_sizes, lookup_join, scan
from traceloom.session import materialize

# Metric names and log line patterns.
METRIC_KEYS = (
    "adp_score", "precision", "recall", "f1", "tp", "fp", "tn", "fn", "auc", "ap",
    "percent_detected_attacks", "discrimination",
)
METRIC_PATTERN = (
    r"(?i)['\"]?(" + "|".join(METRIC_KEYS) + r")['\"]?\s*[:=]\s*(?:np\.\w+\()?([-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?)"
)
VAL_PATTERN = r"(?i)\[@epoch(\d+)\].*Val.*Loss:\s*([-+]?\d+(?:\.\d+)?)"
TEST_PATTERN = r"(?i)\[@epoch(\d+)\].*Test.*Loss:\s*([-+]?\d+(?:\.\d+)?)"
# A key at the end of a line: its value may stand on the next line that is not blank.
OPEN_PATTERN = r"(?i)(?:['\"]?(?:" + "|".join(METRIC_KEYS) + r")['\"]?\s*(?:[:=]\s*(?:np\.\w+\()?)?|\[@epoch\d+\].*(?:Val|Test).*Loss:\s*)$"
OOM_MARKERS = ("out of memory", "oom-kill", "oom killed", "oom_kill")
OOM_EXIT_CODE = 137
TRIAL_PHASE = "hpo"


def _loss(pattern: str) -> Column:
    epoch, loss = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)
    return F.when(epoch != "", F.struct(epoch.cast("int").alias("epoch"), loss.cast("double").alias("loss")))


def _with_values(lines: DataFrame) -> DataFrame:
    """Lines that end in a key, with the next line of their file that is not blank behind them.

    Only files that have such lines are put in order.
    """
    ends_open = F.rlike("text", F.lit(OPEN_PATTERN))
    open_files = materialize(lines.filter(ends_open).select("file").distinct(), "open_files")
    if open_files.isEmpty():
        return lines
    own = lookup_join(lines, open_files, ["file"], ["pos"], "left_semi")
    back, none = -F.col("pos"), F.lit(None).cast("string")
    points = own.filter(F.trim("text") != "").select("file", back.alias("back"), F.lit(1).alias("turn"), F.col("text").alias("seen"), none.alias("text"))
    asks = own.filter(ends_open).select("file", back.alias("back"), F.lit(0).alias("turn"), none.alias("seen"), "text")
    found = scan(points.unionByName(asks), ["file"], ["back", "turn"], {"next": ("last", "seen")}).filter("turn = 0")
    joined = found.select("file", (-F.col("back")).alias("pos"), F.concat_ws("\n", "text", "next").alias("text"))
    rest = lookup_join(lines.filter(~ends_open), open_files, ["file"], ["pos"], "left_semi")
    others = lookup_join(lines, open_files, ["file"], ["pos"], "left_anti")
    return others.select("file", "pos", "text").unionByName(rest.select("file", "pos", "text")).unionByName(joined)


def log_metrics(lines: DataFrame) -> DataFrame:
    """Metrics of every log.  Input: file, pos, text, one row per line; a value may stand on the line after its key.

    Best validation loss (first epoch on ties), last test loss, last value of every metric, out-of-memory flag.
    """
    lines = _with_values(lines)
    lowered = F.lower("text")
    oom = F.lit(False)
    for marker in OOM_MARKERS:
        oom = oom | F.contains(lowered, F.lit(marker))
    read = lines.select("file", "pos", _loss(VAL_PATTERN).alias("val"), _loss(TEST_PATTERN).alias("test"), oom.alias("oom"))
    flags = read.groupBy("file").agg(F.max("oom").alias("oom"))
    best = F.min(F.when(F.col("val").isNotNull(), F.struct(F.col("val.loss").alias("loss"), "pos", F.col("val.epoch").alias("epoch"))))
    losses = read.filter("val is not null or test is not null").groupBy("file").agg(
        best.alias("best"), F.max_by("test", F.when(F.col("test").isNotNull(), F.col("pos"))).alias("last")
    )
    keys = F.regexp_extract_all("text", F.lit(METRIC_PATTERN), F.lit(1))
    values = F.regexp_extract_all("text", F.lit(METRIC_PATTERN), F.lit(2))
    found = (
        lines.filter(F.col("text").rlike(METRIC_PATTERN))
        .select("file", "pos", F.posexplode(F.arrays_zip(keys.alias("key"), values.alias("value"))).alias("nth", "m"))
        .select("file", F.lower("m.key").alias("key"), F.col("m.value").cast("double").alias("value"), "pos", "nth")
    )
    last = found.groupBy("file").pivot("key", list(METRIC_KEYS)).agg(F.max_by("value", F.struct("pos", "nth")))
    return flags.join(losses, "file", "left").join(last, "file", "left").select(
        "file",
        F.col("best.epoch").alias("best_epoch"),
        F.col("best.loss").alias("best_val_loss"),
        F.col("last.epoch").alias("test_epoch"),
        F.col("last.loss").alias("test_loss"),
        "oom",
        *METRIC_KEYS,
    )


def with_exit_code(metrics: DataFrame, exits: DataFrame) -> DataFrame:
    """Out of memory also when the process ended with code 137.  ``exits``: file, exit_code."""
    joined = metrics.join(exits, "file", "left")
    killed = F.coalesce(F.col("exit_code") == OOM_EXIT_CODE, F.lit(False))
    return joined.withColumn("oom", F.col("oom") | killed)


def _with_rung(trials: DataFrame, rungs: DataFrame, how: str = "inner") -> DataFrame:
    """Trials beside a table of one row per (method, rung): rungs are few, so a rung with a third of all trials is not brought together."""
    return lookup_join(trials, materialize(rungs, "rungs"), ["method", "rung"], ["name"], how)


def exit_ok() -> Column:
    """Exit code 0.  A null code counts as 0, an absent one (``exit_code_present`` false) as failed."""
    return F.col("exit_code_present") & (F.coalesce(F.col("exit_code"), F.lit(0)) == 0)


def metric_ok() -> Column:
    """The looser test of the status reports: they do not ask about memory."""
    return exit_ok() & F.col("metric").isNotNull()


def final_ok() -> Column:
    return metric_ok() & ~F.coalesce(F.col("oom"), F.lit(False))


def promotable() -> Column:
    return (F.col("phase") == TRIAL_PHASE) & final_ok()


def leaderboard(rows: DataFrame, group: list[str], maximize: bool = True) -> DataFrame:
    """Position by metric inside each group; rows without a metric come last, ties keep file-name order."""
    worst = F.lit(float("inf"))
    sign = -1.0 if maximize else 1.0
    keyed = rows.withColumn("_worse", F.coalesce(F.col("metric") * F.lit(sign), worst))
    ranked = scan(keyed, group, ["_worse", "file_name"], {"position": ("rank", None)})
    return ranked.drop("_worse")


def last_result_per_name(rows: DataFrame) -> DataFrame:
    """One row per trial name; the last file wins."""
    rest = [c for c in rows.columns if c not in ("method", "rung", "name")]
    picked = rows.groupBy("method", "rung", "name").agg(F.max_by(F.struct(*rest), "file_name").alias("r"))
    return picked.select("method", "rung", "name", "r.*")


def largest_promotion(planned: Column, eta: int) -> Column:
    return F.when(planned > 0, F.greatest(F.lit(1), F.call_function("div", planned, F.lit(eta)))).otherwise(0)


def async_target(completed: Column, planned: Column, eta: int) -> Column:
    share = F.call_function("div", completed, F.lit(eta))
    share = F.when((completed == planned) & (completed > 0) & (share == 0), 1).otherwise(share)
    return F.least(share, largest_promotion(planned, eta))


def rung_counts(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Per (method, rung): planned, completed and valid trials."""
    joined = planned.select("method", "rung", "name").join(results, ["method", "rung", "name"], "left")
    return joined.groupBy("method", "rung").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count("file_name").alias("completed"),
        F.count_if(F.coalesce(promotable(), F.lit(False))).alias("valid"),
    )


def _ranked(planned: DataFrame, results: DataFrame, maximize: bool) -> DataFrame:
    rows = results.filter(promotable()).join(planned.select("method", "rung", "name"), ["method", "rung", "name"], "left_semi")
    return leaderboard(rows, ["method", "rung"], maximize)


def halving_sync(
    planned: DataFrame, results: DataFrame, eta: int, maximize: bool = True, need_checkpoint: bool = False
) -> DataFrame:
    """Trials promoted once every planned trial of the rung has a result.

    With ``need_checkpoint`` a rung waits while one of its chosen trials has no saved checkpoint.
    """
    counts = rung_counts(planned, results)
    target = F.when(
        F.col("completed") >= F.col("planned"), F.least(F.col("valid"), largest_promotion(F.col("planned"), eta))
    ).otherwise(0)
    targets = counts.select("method", "rung", target.alias("target"))
    chosen = _with_rung(_ranked(planned, results, maximize), targets).filter("position <= target")
    if need_checkpoint:
        chosen = materialize(chosen, "chosen")
        waiting = chosen.filter(~has_checkpoint()).select("method", "rung").distinct()
        chosen = _with_rung(chosen, waiting, "left_anti")
    return chosen.select("method", "rung", "name", "metric", "position")


def halving_async(
    planned: DataFrame, results: DataFrame, promoted: DataFrame, eta: int, maximize: bool = True
) -> DataFrame:
    """Trials to promote now: the best ones not promoted yet, up to the target less those promoted."""
    counts = rung_counts(planned, results)
    done = promoted.groupBy("method", "rung").agg(F.count(F.lit(1)).alias("already"))
    slots = counts.join(done, ["method", "rung"], "left").select(
        "method",
        "rung",
        (async_target(F.col("completed"), F.col("planned"), eta) - F.coalesce("already", F.lit(0))).alias("slots"),
    )
    fresh = _ranked(planned, results, maximize).drop("position").join(
        promoted.select("method", "rung", "name"), ["method", "rung", "name"], "left_anti"
    )
    ranked = leaderboard(fresh, ["method", "rung"], maximize)
    return (
        _with_rung(ranked, slots).filter("position <= slots")
        .select("method", "rung", "name", "metric", "position")
    )


def has_checkpoint() -> Column:
    return F.coalesce(F.col("checkpoint_saved"), F.lit(False)) & F.coalesce(F.col("checkpoint_exists"), F.lit(False))


def with_checkpoint_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add checkpoint_exists: whether checkpoint_path is among the listed files (column ``path``)."""
    listed = files.select(F.col("path").alias("checkpoint_path")).distinct().withColumn("checkpoint_exists", F.lit(True))
    joined = rows.join(listed, "checkpoint_path", "left")
    return joined.withColumn("checkpoint_exists", F.coalesce("checkpoint_exists", F.lit(False)))


def reusable(rows: DataFrame, need_checkpoint: bool) -> DataFrame:
    kept = rows.filter(promotable())
    return kept.filter(has_checkpoint()) if need_checkpoint else kept


def to_run(planned: DataFrame, results: DataFrame, need_checkpoint: bool = False) -> DataFrame:
    """Planned trials without a result that may be reused."""
    done = results.filter(metric_ok())
    done = done.filter(has_checkpoint()) if need_checkpoint else done
    return planned.join(done.select("method", "rung", "name"), ["method", "rung", "name"], "left_anti")


def completion_override(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """A failed trial counts as done when its metric is there, it did not run out of memory and its checkpoint
    has reached the target.  ``checkpoints``: name, next_epoch, target_epochs.  The old code is kept."""
    joined = rows.join(checkpoints.select("name", "next_epoch", "target_epochs"), "name", "left")
    reached = F.coalesce(F.col("next_epoch") >= F.col("target_epochs"), F.lit(False))
    saved = (
        (F.col("phase") == TRIAL_PHASE)
        & (F.coalesce("exit_code", F.lit(0)) != 0)
        & ~F.coalesce("oom", F.lit(False))
        & F.col("metric").isNotNull()
        & reached
    )
    return joined.withColumns(
        {
            "completed_by_checkpoint": F.coalesce(saved, F.lit(False)),
            "original_exit_code": F.when(saved, F.col("exit_code")),
            "exit_code": F.when(saved, 0).otherwise(F.col("exit_code")),
        }
    ).drop("next_epoch", "target_epochs")


def final_topk(planned: DataFrame, results: DataFrame, rung: str, k: int = 3, maximize: bool = True) -> DataFrame:
    """The best ``k`` valid trials of a rung, per method, once every planned trial there has a result."""
    plan = planned.filter(F.col("rung") == rung)
    rows = results.filter(F.col("rung") == rung)
    whole = rung_counts(plan, rows).filter("completed >= planned").select("method")
    ranked = _ranked(plan, rows, maximize).filter(F.col("position") <= k)
    return ranked.join(whole, "method", "left_semi").select("method", "name", "metric", "position")


def cutoffs(promoted: DataFrame) -> DataFrame:
    """Metric of the weakest promoted trial per rung."""
    return promoted.groupBy("method", "rung").agg(
        F.min("metric").alias("cutoff"), F.count(F.lit(1)).alias("promoted")
    )


def rung_status(
    planned: DataFrame,
    submitted: DataFrame,
    promoted: DataFrame,
    cancelled: DataFrame,
    results: DataFrame,
    maximize: bool = True,
) -> DataFrame:
    """Planned, submitted, completed, valid, promoted and cancelled trials of every rung, and its best trial."""
    keys = ["method", "rung"]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    done = results.join(submitted.select(*keys, "name"), [*keys, "name"], "left_semi")
    valid = promotable()
    sign = 1.0 if maximize else -1.0
    scored = done.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    top = scored.filter("_ok").groupBy(*keys).agg(F.max(F.col("metric") * F.lit(sign)).alias("top"))
    best = (
        _with_rung(scored.filter("_ok"), top).filter(F.col("metric") * F.lit(sign) == F.col("top"))
        .groupBy(*keys).agg(F.min_by("name", "file_name").alias("best"), F.min_by("metric", "file_name").alias("best_metric"))
    )
    completed = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("_ok").alias("valid")
    )
    status = counted(planned, "planned")
    for df, name in ((submitted, "submitted"), (promoted, "promoted"), (cancelled, "cancelled")):
        status = status.join(counted(df, name), keys, "left")
    status = status.join(completed, keys, "left").join(best, keys, "left")
    numbers = ("planned", "submitted", "completed", "valid", "promoted", "cancelled")
    zero = F.lit(0).cast("bigint")
    return status.select(*keys, *[F.coalesce(c, zero).alias(c) for c in numbers], "best", "best_metric")


def final_status(planned: DataFrame, submitted: DataFrame, results: DataFrame, maximize: bool = True) -> DataFrame:
    """Planned, submitted, completed and valid final trials per method, and the best of them."""
    done = results.join(submitted.select("method", "name"), ["method", "name"], "left_semi")
    best = leaderboard(done.filter(metric_ok()), ["method"], maximize).filter("position = 1")
    parts = [
        planned.groupBy("method").agg(F.count(F.lit(1)).alias("planned")),
        submitted.groupBy("method").agg(F.count(F.lit(1)).alias("submitted")),
        done.groupBy("method").agg(F.count(F.lit(1)).alias("completed"), F.count_if(metric_ok()).alias("valid")),
        best.select("method", F.col("name").alias("best"), F.col("metric").alias("best_metric")),
    ]
    status = parts[0]
    for part in parts[1:]:
        status = status.join(part, "method", "left")
    zero = F.lit(0).cast("bigint")
    counts = ("planned", "submitted", "completed", "valid")
    return status.select("method", *[F.coalesce(c, zero).alias(c) for c in counts], "best", "best_metric")


def cancellable(
    submitted: DataFrame, results: DataFrame, promoted: DataFrame, cancelled: DataFrame, eta: int
) -> DataFrame:
    """Submitted trials nobody waits for: in rungs that have promoted all they can, those without a result, a
    promotion or an earlier cancellation."""
    keys = ["method", "rung"]
    names = [*keys, "name"]
    sent = submitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("sent"))
    moved = promoted.groupBy(*keys).agg(F.count(F.lit(1)).alias("moved"))
    full = sent.join(moved, keys, "left").filter(
        F.coalesce("moved", F.lit(0)) >= largest_promotion(F.col("sent"), eta)
    )
    left = _with_rung(submitted.select(*names), full.select(*keys), "left_semi")
    for other in (results, promoted, cancelled):
        left = left.join(other.select(*names), names, "left_anti")
    return left


def best_result(rows: DataFrame, group: list[str], maximize: bool = True) -> DataFrame:
    """The best trial whose exit code is 0 (a null code does not count here) and whose metric is there."""
    good = rows.filter((F.col("phase") == TRIAL_PHASE) & (F.col("exit_code") == 0) & F.col("metric").isNotNull())
    return leaderboard(good, group, maximize).filter("position = 1").drop("position")


def method_summary(planned: DataFrame, submitted: DataFrame, promoted: DataFrame, results: DataFrame, eta: int) -> DataFrame:
    """Per rung: done, failed, with checkpoint, of these among the best planned/eta, not yet submitted, best."""
    keys = ["method", "rung"]
    good = F.coalesce((F.col("phase") == TRIAL_PHASE) & metric_ok(), F.lit(False))
    flagged = results.withColumn("_good", good)
    ranked = leaderboard(flagged.filter("_good"), keys)
    plan = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"))
    sent = submitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("submitted"))
    moved = promoted.groupBy(*keys).agg(F.count(F.lit(1)).alias("promoted"))
    failed = flagged.groupBy(*keys).agg(F.count_if(~F.col("_good")).alias("failed"))
    deepest = planned.groupBy("method").agg(F.max(F.struct(rung_number(F.col("rung")).alias("n"), "rung")).alias("d"))
    top = F.when(F.col("rung") == F.col("d.rung"), F.lit(None).cast("bigint")).otherwise(
        F.call_function("div", F.col("planned"), F.lit(eta))
    )
    plan = plan.join(deepest, "method").select(*keys, "planned", top.alias("top_k"))
    plan = materialize(plan, "plan")
    tops = _with_rung(ranked, plan).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("done"),
        F.count_if(has_checkpoint()).alias("checkpointed"),
        F.count_if(has_checkpoint() & (F.col("position") <= F.coalesce("top_k", F.col("position")))).alias("top_checkpointed"),
        F.min_by("metric", "position").alias("best_metric"),
    )
    joined = plan.drop("top_k")
    for df in (sent, moved, failed, tops):
        joined = joined.join(df, keys, "left")
    numbers = ("submitted", "promoted", "failed", "done", "checkpointed", "top_checkpointed")
    zero = F.lit(0).cast("bigint")
    joined = joined.select(*keys, "planned", *[F.coalesce(c, zero).alias(c) for c in numbers], "best_metric")
    return joined.withColumn("waiting", F.greatest(zero, F.col("planned") - F.col("submitted"))).withColumn(
        "best", fixed_number(F.col("best_metric"))
    )


def deepest_rung(results: DataFrame) -> DataFrame:
    """Per method the last rung, in numeric order, that has results."""
    return results.groupBy("method").agg(
        F.max_by("rung", F.struct(rung_number(F.col("rung")), "rung")).alias("rung")
    )


def deepest_leaderboard(results: DataFrame, k: int) -> DataFrame:
    rows = _with_rung(results, deepest_rung(results), "left_semi")
    return leaderboard(rows, ["method", "rung"]).filter(F.col("position") <= k)


def final_report(planned: DataFrame, finals: DataFrame, source: DataFrame) -> DataFrame:
    """Planned finals with their result and their rank and metric in the source rung.

    Both ranks are given: ``planned_rank`` (order of selection) and ``final_rank`` (by final metric); a planned
    trial without a result has status missing.
    """
    final = leaderboard(finals, ["method"]).select(
        "method", "name", F.col("metric").alias("final_metric"), F.col("position").alias("final_rank")
    )
    ranked = leaderboard(source, ["method"]).select(
        "method", "name", F.col("metric").alias("source_metric"), F.col("position").alias("source_rank")
    )
    return (
        planned.select("method", "name", F.col("position").alias("planned_rank"))
        .join(final, ["method", "name"], "left")
        .join(ranked, ["method", "name"], "left")
        .withColumn("status", F.when(F.col("final_rank").isNull(), "missing").otherwise("done"))
    )


def name_problems(planned: DataFrame, grid: DataFrame) -> DataFrame:
    """Safe names that are not in the grid, and safe names of the grid that occur more than once."""
    safe = safe_name(F.col("name")).alias("name")
    planned, grid = planned.select(safe), grid.select(safe)
    absent = planned.distinct().join(grid, "name", "left_anti")
    twice = grid.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return absent.select("name", F.lit("not_in_grid").alias("problem")).unionByName(
        twice.select("name", F.lit("duplicate").alias("problem"))
    )


def namespace_inventory(states: DataFrame) -> DataFrame:
    """Run namespaces by suffix: methods, states, rungs, final rows and last update.

    Input: suffix, method, rung, final_rows, updated_at; one row per (suffix, method, rung).
    """
    return states.groupBy("suffix").agg(
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"),
        F.count_distinct("method").alias("states"),
        F.count(F.lit(1)).alias("rungs"),
        F.sum("final_rows").alias("final_rows"),
        F.max("updated_at").alias("updated_at"),
    )


def job_tally(jobs: DataFrame) -> DataFrame:
    """Tasks by method, rung, state and account.  ``jobs``: method, rung, state, account, tasks."""
    return jobs.groupBy("method", "rung", "state", "account").agg(F.sum("tasks").alias("tasks"))


def account_slots(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.groupBy("account").agg(F.sum("tasks").alias("used")).withColumn(
        "free", F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - F.col("used"))
    )


def integer_ranges(items: DataFrame, group: list[str], column: str) -> DataFrame:
    """Runs of consecutive integers as rows: first, last, length and text ``a-b`` or ``a``.

    Rows of groups that fit in a task are shuffled once, copies included; with larger groups copies collapse first.
    """
    kept = items.select(*group, column)
    largest, total = group_sizes(kept, group, HOT_GROUP_ROWS)
    if largest <= HOT_GROUP_ROWS:
        nth = F.dense_rank().over(Window.partitionBy(*group).orderBy(column)).cast("bigint")
        ranked = dealt(kept, group, total).withColumn("_n", nth)
    else:
        pair = [*group, column]
        most = group_sizes(kept, pair, HOT_GROUP_ROWS)[0]
        distinct = materialize((dealt(kept, pair, total) if most <= HOT_GROUP_ROWS else kept).distinct(), "items")
        ranked = scan(distinct, group, [column], {"_n": ("rank", None)})
    island = ranked.groupBy(*group, (F.col(column) - F.col("_n")).alias("_island")).agg(F.min(column).alias("first"), F.max(column).alias("last"))
    length = F.coalesce(F.col("last").cast("bigint") - F.col("first") + 1, F.lit(1))
    text = F.when(F.col("length") == 1, F.col("first").cast("string")).otherwise(
        F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))
    )
    return island.drop("_island").withColumn("length", length).withColumn("text", text)


def range_text(ranges: DataFrame, group: list[str]) -> DataFrame:
    """The ranges of a short list, such as the task numbers of one grid, as one text ``1-3,7,9-10``."""
    ordered = F.array_sort(F.collect_list(F.struct("first", "text")))
    return ranges.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), ",").alias("spec"))


def task_count(job: Column) -> Column:
    """Tasks of an array job id ``123_[1-3,7%10]``; 1 for other ids."""
    inside = F.split(F.regexp_extract(job, r"_\[(.*)\]", 1), "%")[0]
    spans = F.filter(F.split(inside, ","), lambda s: s != "")
    sizes = F.transform(
        spans,
        lambda s: F.when(
            F.contains(s, F.lit("-")),
            F.substring_index(s, "-", -1).try_cast("int") - F.substring_index(s, "-", 1).try_cast("int") + 1,
        ).otherwise(1),
    )
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    return F.when(F.contains(job, F.lit("_[")), F.greatest(F.coalesce(total, F.lit(1)), F.lit(1))).otherwise(1)


def ordered_union(first: DataFrame, second: DataFrame, group: list[str]) -> DataFrame:
    """Items of ``first`` in order, then unseen items of ``second``.  Input: group…, pos, item."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    seen = both.groupBy(*group, "item").agg(F.min(F.struct("_list", "pos")).alias("at"))
    flat = materialize(seen.select(*group, "item", "at._list", "at.pos"), "union")
    return scan(flat, group, ["_list", "pos"], {"position": ("rank", None)}).drop("_list", "pos")


def without(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``planned`` whose keys are not in ``done``; their order columns stay."""
    return planned.join(done.select(*keys), keys, "left_anti")
