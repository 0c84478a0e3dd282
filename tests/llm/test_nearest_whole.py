"""Every query has all the ranks it can have, wherever it lies."""

import collections

import numpy as np

from traceloom.llm import op6_ann


def _ranks(spark, ids, x):
    out = collections.defaultdict(list)
    rows = [(int(i), [float(v) for v in vector]) for i, vector in zip(ids, x, strict=True)]
    for r in op6_ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(found) for q, found in out.items()}


def test_queries_in_sparse_regions_have_all_ranks(spark):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(8, 24))
    x = middles[np.arange(1600) % 8] + 0.02 * draw.normal(size=(1600, 24))  # tight clusters of 200 rows
    x[1200::20] = draw.normal(size=(20, 24))  # and queries far from any of them
    found = _ranks(spark, range(1600), x)
    assert set(found) == set(range(0, 1600, 20))
    for q, rows in found.items():
        assert [rank for rank, _, _ in rows] == list(range(1, 21)) and len({v for _, v, _ in rows} - {q}) == 20
        assert all(abs(score - x[v] @ x[q]) < 1e-9 for _, v, score in rows)


def test_few_candidates_are_all_returned(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(12, 8))
    found = _ranks(spark, [*range(11), 0], x)  # two rows of the query's own id are no candidates
    assert set(found) == {0} and {v for _, v, _ in found[0]} == set(range(1, 11))
