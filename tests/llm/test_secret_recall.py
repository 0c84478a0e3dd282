"""Random letters of one case are told from ordinary words, in tokens of the usual lengths."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.llm import op1_secrets

WORDS = "the value number of elements returned from window function with an optional column name string example returns frame table order group count partition between current following".split()
SMALL = "abcdefghijklmnopqrstuvwxyz"


def _joined(draw, length):
    out = ""
    while len(out) < length:
        out += draw.choice(WORDS)
    return out[:length]


@pytest.mark.parametrize("length, least", [(24, 0.7), (40, 0.9)])
def test_random_letters_look_random(spark, length, least):
    draw = random.Random(length)
    rows = [("".join(draw.choice(SMALL) for _ in range(length)), 1) for _ in range(200)] + [(_joined(draw, length), 0) for _ in range(200)]
    rows += [(token.upper(), kind) for token, kind in rows]
    out = spark.createDataFrame(rows, "token string, kind int").select("kind", op1_secrets.p_value(F.col("token")).alias("p")).collect()
    assert sum(r.p <= 1e-3 for r in out if r.kind) >= least * 400
    assert not any(r.p <= 1e-3 for r in out if not r.kind)


def test_planted_letters_are_reported(spark):
    draw = random.Random(8)
    planted = {i: "".join(draw.choice(SMALL) for _ in range(40)) for i in range(0, 400, 20)}
    texts = [(i, "see " + (planted.get(i) or _joined(draw, 40)) + " here") for i in range(400)]
    out = op1_secrets.digests(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    found = {r.doc_id for r in out if r.spans == "random:4:44"}
    assert found <= set(planted) and len(found) >= 15
    assert all(r.spans == "" for r in out if r.doc_id not in found)
