"""Spans that the trees add: guarded addresses and plain numbers that a word announces are found, look-alikes are left."""

import random

from traceloom.llm import op5_pii


def _planted(draw, i):
    """A text, and where its guarded or announced personal data stands (None: it holds none)."""
    fill = " ".join(draw.choice(["river", "stone", "paper", "cloud", "green"]) for _ in range(draw.randrange(3, 9)))
    kind = i % 8
    if kind == 0:
        sign, value = "email", f"user{i}[at]host{i % 7}[dot]org"
        text = f"{fill} contact {value} today"
    elif kind == 1:
        sign, value = "ip", f"10[.]{draw.randrange(256)}[.]{draw.randrange(256)}[.]{draw.randrange(256)}"
        text = f"{fill} host {value} is down"
    elif kind == 2:
        sign, value = "phone", f"0{draw.randrange(10**9, 10**10)}"
        text = f"{fill} call {value} now"
    elif kind == 3:
        return f"{fill} write to a{i}@b{i % 5}.com or phone +49 30 {draw.randrange(10**6, 10**7)}", None
    elif kind == 4:
        return f"{fill} order {draw.randrange(10**9, 10**10)} shipped", None
    elif kind == 5:
        return f"{fill} version 300[.]{draw.randrange(300, 999)}[.]400[.]{draw.randrange(300, 999)} built", None
    elif kind == 6:
        return f"{fill} serial {draw.randrange(10**15, 10**16)} ends", None
    else:
        return fill, None
    at = text.index(value)
    return text, (sign, at, at + len(value))


def test_guarded_and_announced_data_is_added(spark):
    draw = random.Random(12)
    made = [_planted(draw, i) for i in range(1600)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id bigint, text string")
    hit = planted = added = right = 0
    for r in op5_pii.personal_data(rows).collect():
        spans = {(s.kind, s.start, s.end) for s in r.added}
        wanted = made[r.doc_id][1]
        planted += wanted is not None
        hit += wanted in spans
        added += len(spans)
        right += sum(s == wanted for s in spans)
    assert planted == 600 and hit >= 0.9 * planted
    assert right >= 0.95 * added


def test_redacted_texts(spark):
    texts = ["a@b.com and 10.0.0.1", "é +49 30 1234567é x@y.org, x@y.org", None, "", "nothing", "1.2.3.4" * 400]
    got = {r.doc_id: r.text for r in op5_pii.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0] == "[email] and [ip]" and got[1] == "é [phone]é [email], [email]"
    assert (got[2], got[3], got[4]) == ("", "", "nothing")
