import json

import pytest
from pyspark.sql import functions as F

from traceloom.operators import grids, splits, trials
from traceloom.operators import incremental
from traceloom.sources import sinks, tables

RESULT = (
    "method string, rung string, name string, metric double, phase string, exit_code int, exit_code_present boolean, oom boolean, "
    "checkpoint_saved boolean, checkpoint_exists boolean, file_name string"
)


def result(name, metric, rung="r0_e1", exit_code=0, present=True, oom=False, saved=True):
    return ("m", rung, name, metric, "hpo", exit_code, present, oom, saved, saved, f"{name}.json")


def frame(spark, rows):
    return spark.createDataFrame(rows, RESULT)


@pytest.mark.parametrize("eta, sizes", [(2, (243, 121, 60, 30)), (3, (81, 27, 9)), (2, (1, 1))])
def test_halving_sizes(spark, eta, sizes):
    for n, expected in zip(sizes, sizes[1:]):
        rows = frame(spark, [result(f"c{i:03d}", float(i % 17)) for i in range(n)])
        assert trials.halving_sync(rows, rows, eta).count() == expected


def test_halving_waits(spark):
    planned = frame(spark, [result(f"c{i}", 1.0) for i in range(4)])
    results = frame(spark, [result("c0", 1.0), result("c1", 3.0), result("c2", 2.0)])
    assert trials.halving_sync(planned, results, 2).isEmpty()
    now = trials.halving_async(planned, results, planned.limit(0), 2)
    assert [r["name"] for r in now.collect()] == ["c1"]
    assert trials.halving_async(planned, results, results.filter("name = 'c1'"), 2).isEmpty()
    unsaved = frame(spark, [result("c0", 1.0), result("c1", 3.0, saved=False), result("c2", 2.0), result("c3", 0.0)])
    assert trials.halving_sync(planned, unsaved, 2, need_checkpoint=True).isEmpty()
    assert {r["name"] for r in trials.halving_sync(planned, unsaved, 2).collect()} == {"c1", "c2"}


def test_promotable(spark):
    rows = frame(
        spark,
        [
            result("ok", 1.0), result("null code", 1.0, exit_code=None), result("no code", 1.0, exit_code=None, present=False),
            result("failed", 1.0, exit_code=1), result("oom", 1.0, oom=True), result("no metric", None),
        ],
    )
    assert {r["name"] for r in rows.filter(trials.promotable()).collect()} == {"ok", "null code"}


def test_leaderboard_ties(spark):
    rows = frame(spark, [result("b", 1.0), result("a", 1.0), result("z", None), result("t", 2.0)])
    order = [r["name"] for r in trials.leaderboard(rows, ["method"]).orderBy("position").collect()]
    assert order == ["t", "a", "b", "z"]
    order = [r["name"] for r in trials.leaderboard(rows, ["method"], maximize=False).orderBy("position").collect()]
    assert order == ["a", "b", "t", "z"]


def test_status_and_final(spark):
    rows = frame(spark, [result("a", 1.0), result("b", 5.0), result("c", 5.0), result("d", None)])
    status = trials.rung_status(rows, rows, rows.limit(0), rows.limit(0), rows).first()
    assert (status["planned"], status["valid"], status["best"], status["best_metric"]) == (4, 3, "b", 5.0)
    top = trials.final_topk(rows, rows, "r0_e1", 2)
    report = trials.final_report(top, rows.filter("name = 'b'"), rows).orderBy("planned_rank").collect()
    assert [(r["name"], r["status"], r["final_rank"], r["source_rank"]) for r in report] == [("b", "done", 1, 1), ("c", "missing", None, 2)]
    summary = trials.method_summary(rows, rows, rows.limit(0), rows, 2).first()
    assert (summary["done"], summary["failed"], summary["best"]) == (3, 1, "5.000")


def test_completion_override(spark):
    rows = frame(spark, [result("a", 1.0, exit_code=1), result("b", None, exit_code=1), result("c", 1.0)])
    saved = spark.createDataFrame([("a", 4, 4), ("b", 4, 4)], "name string, next_epoch int, target_epochs int")
    got = {r["name"]: (r["exit_code"], r["original_exit_code"]) for r in trials.completion_override(rows, saved).collect()}
    assert got == {"a": (0, 1), "b": (1, None), "c": (0, None)}


def test_log_metrics(spark, tmp_path):
    (tmp_path / "one.log").write_text(
        "[@epoch0] Val 1 Loss: 0.9\nnoise\n[@epoch1] x Val Loss: 0.41\n[@epoch2] Val Loss: 0.41\n"
        "[@epoch1] Test Loss: 0.6\n[@EPOCH2] test loss: 0.52\n{'adp_score': np.float64(0.7), 'precision': 0.5}\nadp_score = 0.8e-1\n"
    )
    (tmp_path / "two.log").write_text("slurm: OOM Killed\n")
    rows = {r["file"]: r for r in trials.log_metrics(tables.read_logs(spark, str(tmp_path))).collect()}
    one = rows["one.log"]
    assert (one["best_epoch"], one["best_val_loss"], one["test_epoch"], one["test_loss"]) == (1, 0.41, 2, 0.52)
    assert (one["adp_score"], one["precision"], one["recall"], one["oom"]) == (0.08, 0.5, None, False)
    assert rows["two.log"]["oom"] and rows["two.log"]["best_epoch"] is None


def test_result_files(spark, tmp_path):
    files = {
        "a.json": {"name": "x", "phase": "hpo", "exit_code": None, "adp_score": "0.5", "zeta": 1, "overrides": {"lr": 0.1}},
        "b.json": {"name": "x", "phase": "hpo", "adp_score": 0.7},
        "results.json": [{"name": "x"}],
        "c.json": {"phase": "hpo"},
    }
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "bad.json").write_text("{")
    rows = tables.read_results(spark, str(tmp_path))
    got = {r["file_name"]: r for r in rows.collect()}
    assert set(got) == {"a.json", "b.json"}
    assert got["a.json"]["exit_code_present"] and not got["b.json"]["exit_code_present"]
    assert got["a.json"]["metric"] == 0.5 and got["a.json"]["overrides"] == {"lr": "0.1"}
    last = trials.last_result_per_name(rows).collect()
    assert [(r["name"], r["file_name"]) for r in last] == [("x", "b.json")]
    assert sinks.result_columns(rows).columns == [*sinks.RESULT_COLUMNS, "zeta"]
    sinks.write_results(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).columns[-1] == "zeta"


def test_ranges(spark):
    items = spark.createDataFrame([("g", n) for n in (10, 1, 2, 3, 7, 9, 9)], "g string, n bigint")
    spec = trials.range_text(trials.integer_ranges(items, ["g"], "n"), ["g"]).first()["spec"]
    assert spec == "1-3,7,9-10"
    jobs = spark.createDataFrame([("1_[1-3,7,9-10%4]",), ("12",), ("3_4",), ("5_[x]",)], "j string")
    assert [r["n"] for r in jobs.select(trials.task_count(F.col("j")).alias("n")).collect()] == [6, 1, 1, 1]


def test_ordered_union(spark):
    first = spark.createDataFrame([(1, "b"), (2, "a")], "pos int, item string")
    second = spark.createDataFrame([(1, "c"), (2, "a"), (3, "d")], "pos int, item string")
    merged = trials.ordered_union(first, second, []).orderBy("position").collect()
    assert [r["item"] for r in merged] == ["b", "a", "c", "d"]


GRID_NAMES = {
    "magic": ["c000_win1m_lr0p001_wd0p0005_dim64_mask0p5_seed0", "c001_win1m_lr0p0003_wd0p0001_dim32_mask0p3_seed0", "c195_win4m_lr0p001_wd0p0001_dim128_mask0p3_seed0"],
    "velox": ["c167_lr0p001_wd0_dim64_emb128_batch2048_seed0", "c003_lr0p0001_wd0_dim64_emb64_batch2048_seed0"],
    "orthrus": ["c233_lr0p0001_wd1em05_capmedium_batch2048_neigh50_seed0", "c206_lr0p0001_wd1em06_capmedium_batch2048_neigh50_seed0"],
    "kairos": ["c001_lr2em05_wd0p001_capsmall_batch512_neigh10_seed0", "c103_lr5em05_wd0p001_caplarge_batch1024_neigh10_seed0"],
}


@pytest.mark.parametrize("method", sorted(GRID_NAMES))
def test_published_grids(spark, method):
    grid = grids.published_grid(spark, method)
    rows = grid.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(243))
    assert set(GRID_NAMES[method]) <= {r["name"] for r in rows}
    assert tuple(rows[0][a] for a in grids.GRIDS[method]["axes"]) == grids.GRIDS[method]["default"]
    plan = grids.planned_runs(grid, method)
    assert plan.count() == 243 * 4
    assert trials.name_problems(plan, grid).isEmpty()


def test_overrides(spark):
    row = grids.planned_runs(grids.published_grid(spark, "kairos"), "kairos").filter("index = 1 and rung = 'r1_e2'").first()
    assert row["resume_from"] == "r0_e1" and row["epochs"] == 2
    assert row["overrides"]["training.encoder.tgn.tgn_memory_dim"] == "64" and row["overrides"]["training.lr"] == "2e-05"
    templates = spark.createDataFrame([("t", {"training.seed": "7"})], "name string, overrides map<string,string>")
    runs = grids.expand_templates(templates, [1, 2]).orderBy("seed").collect()
    assert [r["name"] for r in runs] == ["t_seed1", "t_seed2"]
    assert runs[1]["overrides"] == {"training.seed": "7", "featurization.seed": "2"}
    assert grids.expand_templates(templates, []).first()["name"] == "t"


def test_split_counts():
    golden = {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 7: (4, 1, 2), 10: (7, 1, 2), 20: (14, 3, 3), 90: (62, 13, 15)}
    assert {n: splits.split_counts(n) for n in golden} == golden
    assert splits.split_counts(10, 0.9, 0.5) == (4, 5, 1)
    assert splits.attack_counts(5, False, 0.15, 0.15) == (0, 5)
    assert splits.attack_counts(5, True, 0.15, 0.15) == (2, 3)
    assert splits.attack_counts(1, True, 0.15, 0.15) == (0, 1)
    assert splits.attack_counts(3, True, 1.0, 0.0) == (2, 1)


def test_incremental(spark):
    found = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("c", "/c"), ("d", "/d")], "run_id string, source_file string")
    stored = spark.createDataFrame([("a", "/a", 3), ("b", "/x", 3), ("c", "/c", 2)], "run_id string, source_file string, schema_version int")
    plan = {r["run_id"]: r["status"] for r in incremental.build_plan(found, stored).collect()}
    assert plan == {"a": "skipped", "b": "rebuilt", "c": "rebuilt", "d": "built"}


def test_carriage_returns_end_log_lines(spark, tmp_path):
    (tmp_path / "cr.out").write_bytes(b"[@epoch1] Val Loss: 0.9\r[@epoch2] Val Loss: 0.1\r\n[@epoch1] Test Loss: 0.4\r[@epoch2] Test Loss: 0.2\n")
    row = trials.log_metrics(tables.read_logs(spark, str(tmp_path))).first()
    assert (row["best_epoch"], row["best_val_loss"], row["test_epoch"], row["test_loss"]) == (2, 0.1, 2, 0.2)
