"""Lines are sent to executors only as far as their number is bounded; many of them, null ids included, give the same result."""

from traceloom.llm import op8_line_dedup

LINE = "a line of some length that stands in many documents and is told apart by one number only"


def test_many_lines_are_not_sent(spark, monkeypatch):
    rows = [(i if i % 3 else None, f"own {i} words of {i * 7} here\n{LINE} {i % 4}\n{LINE} {i}") for i in range(30)] + [(7, f"{LINE} 7\nanother text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    sent = []
    broadcast = op8_line_dedup.F.broadcast
    expected = sorted(map(repr, op8_line_dedup.line_dedup(docs).collect()))
    monkeypatch.setattr(op8_line_dedup, "SENT_ROWS", 3, raising=False)
    monkeypatch.setattr(op8_line_dedup.F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    assert sorted(map(repr, op8_line_dedup.line_dedup(docs).collect())) == expected
    assert not any({"lines", "gone"} & set(columns) for columns in sent)
