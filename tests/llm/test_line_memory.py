"""A task holds the texts of a few rows as Python strings, not those of a whole batch."""

import tracemalloc

import pyarrow as pa

from traceloom.llm import op8_line_dedup as op


def test_lines_are_read_in_slices():
    texts = [f"{n} " + "x" * 5000 for n in range(4000)] + [None, "", "a\n\n b"]
    batch = pa.record_batch({"doc_id": [None, *range(1, len(texts))], "doc": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        rows = [r for out in op._places(iter([batch])) for r in out.select(["doc_id", "line", "item"]).to_pylist()]
        assert tracemalloc.get_traced_memory()[1] - before < 10_000_000
    finally:
        tracemalloc.stop()
    assert [(r["doc_id"], r["line"]) for r in rows] == [(None, 0), *((n, 0) for n in range(1, 4000)), (4002, 0), (4002, 2)]
    assert rows[-1]["item"] == op.line_digest("b")
