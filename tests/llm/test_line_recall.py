"""What the banding of lines may miss, against what it states."""

import numpy as np

from traceloom.llm import hashing, op8_line_dedup


def test_line_bands_hold_pairs_at_the_threshold():
    """Pairs of sets at a Jaccard similarity of 0.7536 (52 of 69), the least above the threshold for sets of that size."""
    draw = np.random.default_rng(1)
    left, right = [], []
    for _ in range(8000):
        own = draw.integers(0, 1 << 63, size=69, dtype=np.uint64)
        left.append(own[:60])
        right.append(own[8:])
    bands, rows = op8_line_dedup.BANDS, op8_line_dedup.ROWS
    a, b = (hashing.wide_band_keys(hashing.minhashes(x, bands * rows), bands, rows) for x in (left, right))
    assert (a == b).any(axis=1).mean() >= 0.999
