"""Line dedup row by row: repeated ids, rows without ids, and columns with names the operator uses itself."""

from traceloom.llm import op8_line_dedup as op

LONG = "a line that is long enough to have shingles of its own and more"
OWN = "something else altogether that only the first of them has to say"
THIRD = "quite other words in a sentence that stands nowhere else in here"


def test_repeated_ids_lose_their_own_lines_only(spark):
    rows = [(1, f"{LONG}\n{OWN}"), (2, f"{LONG}\n{LONG}"), (2, THIRD), (2, f"{THIRD}\n{LONG}")]
    found = sorted((r["doc_id"], r["n_lines"], r["n_kept"], r["text"]) for r in op.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [r[:3] for r in found if r[0] == 1] == [(1, 2, 2)]
    second = [r for r in found if r[0] == 2]
    # Which of the two rows keeps the third line is up to the digest of their texts.
    assert sorted(r[1:3] for r in second) in ([(1, 0), (2, 0), (2, 1)], [(1, 1), (2, 0), (2, 0)])
    assert all(0 <= r[2] <= r[1] for r in found) and sum(THIRD in r[3] for r in found) == 1 and sum(LONG in r[3] for r in found) == 1


def test_rows_without_ids_lose_repeated_lines(spark):
    rows = [(None, f"{LONG}\n{OWN}"), (None, f"{LONG}\n{THIRD}"), (7, LONG)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = op.line_dedup(frame).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_kept"], r["text"]) for r in found} == {(7, 1, 1, LONG), (None, 2, 1, OWN), (None, 2, 1, THIRD)}
    alone = op.line_dedup(frame.filter("doc_id is null")).collect()
    assert sum(LONG in r["text"] for r in alone) == 1 and sorted(r["n_kept"] for r in alone) == [1, 2]


def test_clashing_names_and_blank_rows(spark):
    names = ["doc_id", "text", "doc", "gone", "all", "n_dropped", "n_chars", "item", "_doc", "line"]
    rows = [(1, LONG, *"abcd", 5, *"efg"), (2, f"{LONG}\n{OWN}", *"abcd", 5, *"efg"), (2, " \n ", *"abcd", 5, *"efg"), (2, LONG, *"abcd", 5, *"efg"), (3, None, *"abcd", 5, *"efg")]
    schema = ", ".join(f"`{n}` {'bigint' if n in ('doc_id', 'n_chars') else 'string'}" for n in names)
    out = op.without_repeats(spark.createDataFrame(rows, schema))
    assert out.columns == names
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"], r["all"], r["gone"]) for r in out.collect())
    assert got == [(1, LONG, 5, "c", "b"), (2, " \n ", 5, "c", "b"), (2, OWN, len(OWN), "c", "b"), (3, "", 5, "c", "b")]
