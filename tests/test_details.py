"""Log values on the next line, %g tokens, decoder errors of problem lines, leaderboards as JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from traceloom.functions import names
from traceloom.operators import trials
from traceloom.sources import raw, sinks, tables

_METRIC = re.compile(r"(?i)['\"]?(" + "|".join(trials.METRIC_KEYS) + r")['\"]?\s*[:=]\s*(?:np\.\w+\()?([-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?)")
_VAL, _TEST = re.compile(trials.VAL_PATTERN), re.compile(trials.TEST_PATTERN)


def whole(text):
    """Metrics of a log read as one text."""
    found = {m.group(1).lower(): float(m.group(2)) for m in _METRIC.finditer(text)}
    vals = [(float(m.group(2)), int(m.group(1))) for m in _VAL.finditer(text)]
    tests = [(float(m.group(2)), int(m.group(1))) for m in _TEST.finditer(text)]
    best = min(vals, key=lambda v: v[0]) if vals else (None, None)
    last = tests[-1] if tests else (None, None)
    return (*best, *last, *[found.get(k) for k in trials.METRIC_KEYS])


def test_values_on_the_next_line(spark, tmp_path):
    draw = random.Random(2)
    parts = ["'adp_score':", "precision", "  = np.float64(", " 0.5", "0.25)", "1e-3", "noise", "", "  ", "[@epoch3] Val Loss:", "[@epoch4] a Test b Loss: ", "0.75", "tp=", "7", "recall : 0.5, f1 :", "[@epoch5] Val Loss: 0.125", "fn"]
    texts = {f"log{n}": "\n".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for n in range(60)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    columns = ["best_val_loss", "best_epoch", "test_loss", "test_epoch", *trials.METRIC_KEYS]
    got = {r["file"]: tuple(r[c] for c in columns) for r in trials.log_metrics(tables.read_logs(spark, str(tmp_path))).collect()}
    for name, text in texts.items():
        if text:
            assert got[name] == whole(text), text


def test_general_numbers(spark):
    draw = random.Random(3)
    values = [0.0, 1.0, -1.5, 100000.0, 1e6, 123456789.0, 1e-4, 1e-5, 0.00012345678, 1e300, -2.5e-300, 0.1 + 0.2, 99999.96, 999999.6]
    values += [draw.uniform(-1, 1) * 10 ** draw.randrange(-12, 15) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in frame.select("v", names.general_number(F.col("v")), names.number_token(F.col("v"))).collect()]
    assert got == [(v, f"{v:g}", f"{v:g}".replace(".", "p").replace("-", "m")) for v in values]


def test_problem_details(spark, tmp_path):
    lines = [b'{"id": 1}', b'{"id": "caf\xe9"}', b'{"id": "a"b"c"}', b"[1]", b'{"id"', b'{"id": "\xff"x"}']
    (tmp_path / "svc_benign_1_recap.jsonl").write_bytes(b"\n".join(lines))
    got = {r["line_number"]: r for r in raw.problem_details(raw.audit_lines(raw.read_lines(spark, str(tmp_path)))).collect()}
    assert set(got) == {2, 3, 4, 5, 6}
    assert got[2]["strict_error"].startswith("UnicodeDecodeError") and got[2]["latin1_error"] is None
    assert "delimiter" in got[3]["strict_error"] and "delimiter" in got[3]["latin1_error"] and got[3]["repaired_positions"] == [9, 12]
    assert got[4]["strict_error"] == "ValueError: JSON line did not decode to an object" and got[4]["repaired_positions"] is None
    assert got[5]["tier"] == "unrepaired" and "delimiter" in got[5]["latin1_error"]
    assert got[6]["tier"] == "repairable_escape_quotes" and got[6]["repaired_positions"] == [9]


@pytest.mark.parametrize("maximize", [True, False])
def test_leaderboard_as_json(spark, tmp_path, maximize):
    for n in range(5):
        (tmp_path / f"r{n}.json").write_text(json.dumps({"name": f"t{n}", "method": "m", "phase": "hpo", "exit_code": 0, "adp_score": n / 4, "overrides": {"lr": n}}))
    ranked = trials.leaderboard(tables.read_results(spark, str(tmp_path)), ["method"], maximize)
    sinks.write_leaderboard(ranked, str(tmp_path / "board.csv"), str(tmp_path / "board"))
    rows = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "board")).collect()), key=lambda r: r["position"])
    assert [r["result"]["name"] for r in rows] == [f"t{n}" for n in (range(4, -1, -1) if maximize else range(5))]
    assert rows[0]["overrides"]["lr"] == ("4" if maximize else "0")
