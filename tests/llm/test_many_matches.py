"""Texts with very many matches: right, and without comparing each match with each."""

import random
import re
import time

import pytest
from brute_spans import personal, secrets
from pyspark.sql import functions as F

from traceloom.llm import op1_secrets, op3_licenses, op5_pii, spans

LONG = 20_000  # matches in a text of about 1 MB
SECONDS = 30  # a product over all pairs takes minutes


def _one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def test_running_and_below(spark):
    draw = random.Random(6)
    for n in (0, 1, 2, 3, 5, 17, 200):
        values = [draw.randrange(9) for _ in range(n)]
        rows = spark.createDataFrame([(values,)], "v array<int>")
        sums = [sum(values[: i + 1]) for i in range(n)]
        maxima = [max(values[: i + 1]) for i in range(n)]
        got = rows.select(spans.running(F.col("v"), lambda a, x: a + x).alias("s"), spans.running(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).first()
        assert (got.s, got.m) == (sums, maxima)
        bounds = list(range(-1, sum(values) + 3))
        asked = spark.createDataFrame([(sums, bounds)], "v array<int>, b array<int>")
        found = asked.select(F.transform("b", lambda b: spans.below(F.col("v"), b)).alias("n")).first().n
        assert found == [sum(x < b for x in sums) for b in bounds]


def test_cut(spark):
    draw = random.Random(7)
    text = "".join(draw.choice("ab \n\u00e9\U0001f600") for _ in range(1100))
    places = [(draw.randrange(1100), draw.randrange(700)) for _ in range(60)] + [(0, 0), (255, 1), (256, 1), (0, 1100), (1099, 1)]
    rows = spark.createDataFrame([(text, places)], "text string, p array<struct<a:int,n:int>>")
    got = rows.select(F.transform("p", lambda p: spans.cut(spans.pages(F.col("text")), p["a"], p["n"])).alias("c")).first().c
    assert got == [text[a : a + n] for a, n in places]


def test_apart_and_among(spark):
    draw = random.Random(8)
    form = "a array<struct<kind:string,rank:int,start:int,end:int,text:string>>, b array<struct<kind:string,rank:int,start:int,end:int,text:string>>"
    for n in (0, 1, 4, 40):
        made = []
        for rank in range(3):
            at = 0
            for _ in range(n):
                at += draw.randrange(1, 12)
                made.append((str(rank), rank, at, at := at + draw.randrange(1, 9), ""))
        made.sort(key=lambda s: (s[2], s[1], s[3]))
        asked = made[::3] + [("x", draw.randrange(3), s := draw.randrange(300), s + draw.randrange(1, 20), "") for _ in range(80)]
        rows = spark.createDataFrame([(made, asked)], form)
        got = rows.select(
            F.transform("b", lambda s: spans.apart(s, spans.borders(F.col("a")))).alias("apart"), F.transform("b", lambda s: spans.among(s, spans.by_rank(F.col("a"), 3))).alias("among")
        ).first()
        assert got.apart == [not any(o[2] < s[3] and s[2] < o[3] for o in made) for s in asked]
        assert got.among == [any(o[1:4] == s[1:4] for o in made) for s in asked]


def test_best_of_overlapping(spark):
    draw = random.Random(9)
    for n in (0, 1, 3, 30):
        rows = []
        for _ in range(n):
            at = draw.randrange(150)
            rows.append((draw.randrange(4) / 2, ("k", draw.randrange(3), at, at + draw.randrange(1, 12), "")))
        stay = []
        for _, s in sorted(set(rows), key=lambda j: (-j[0], j[1][2] - j[1][3], j[1][2], j[1][1])):
            if not any(o[2] < s[3] and s[2] < o[3] for o in stay):
                stay.append(s)
        frame = spark.createDataFrame([(rows,)], "j array<struct<score:double,span:struct<kind:string,rank:int,start:int,end:int,text:string>>>")
        got = frame.select(spans.in_order(op5_pii._best(F.col("j"))).alias("s")).first().s
        assert [tuple(s) for s in got] == sorted(stay, key=lambda s: (s[2], s[1], s[3]))


def _timed(frame):
    began = time.time()
    row = frame.first()
    assert time.time() - began < SECONDS
    return row


def test_many_secrets(spark):
    draw = random.Random(1)
    text = " ".join(f"token={draw.getrandbits(40):x}zz and {draw.getrandbits(120):030x}" for _ in range(LONG // 2))
    row = _timed(op1_secrets.digests(_one(spark, text)))
    assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == secrets(text)


def test_many_personal_data(spark):
    draw = random.Random(2)
    text = " ".join(f"write to u{i}@host{i % 9}.example.org or call +49 {draw.randrange(10**9, 10**10)}, \u00e9" for i in range(LONG // 2))
    row = _timed(op5_pii.digests(_one(spark, text)))
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == personal(text)


def test_many_licenses(spark):
    text = "Released under the MIT License. Code under Apache License, Version 2.0. " * (LONG // 2)
    row = _timed(op3_licenses.license_scan(_one(spark, text)))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), LONG, 1, len(words) - 5)
    assert row.base_labels == "apache-2,mit" and len(row.detections) >= LONG


@pytest.mark.parametrize("seed", [3, 4])
def test_license_places_and_suppression(spark, seed):
    draw = random.Random(seed)
    bits = ["under the mit license", "Apache License, Version 2.0", "cc by nc", "CC-BY-NC-SA 4.0", "gnu lesser general public license v2.1", "gpl", "licensed under the", "bsd 3-clause", "word", "\u00e9t\u00e9", "mit", "."]
    texts = [" ".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(60)]
    got = {r.doc_id: r for r in op3_licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    phrases = [(p.split(), label) for p, label in op3_licenses.BASE]
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((at, label) for p, label in phrases for at in range(len(words)) if words[at : at + len(p)] == p)
        row = got[i]
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), first, last)
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        norm = op3_licenses.normalise(text)[0]
        hits = [(-r.priority, m.start() - m.end(), m.start(), order, m.end(), r.label) for order, r in enumerate(op3_licenses.rules()) for m in r.pattern.finditer(norm)]
        taken = []
        for _, _, start, _, end, label in sorted(hits):
            if not any(s <= start and end <= e for s, e, _ in taken):
                taken.append((start, end, label))
        plain = [(norm.count(b" ", 0, s) - 1, norm.count(b" ", 0, e), label) for s, e, label in sorted(taken)]
        assert [(d.first, d.end, d.label) for d in row.detections] == plain
