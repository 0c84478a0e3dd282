"""Minima from bins and sketches: what long lines may miss, that similar lines of any length meet, and that sketches reject no similar pair."""

import random

import numpy as np

from traceloom.llm import hashing
from traceloom.llm import op8_line_dedup as op


def test_bins_hold_pairs_at_the_threshold():
    """Sets of at least ``LONG`` shingles at a similarity of 0.7527 (140 of 186); those without a shingle in common share no key."""
    draw = np.random.default_rng(1)
    met, chance = 0, 0
    for _ in range(8):
        own = [draw.integers(0, 1 << 63, size=186, dtype=np.uint64) for _ in range(1000)]
        a, b = (op._binned_keys(x) for x in ([s[:163] for s in own], [s[23:] for s in own]))
        met += int((a == b).any(axis=1).sum())
        chance += int((a == np.roll(b, 1, axis=0)).sum())
    assert met >= 0.999 * 8000 and chance == 0


def test_lines_beside_the_border_meet():
    """Variants of a line on both sides of ``LONG``, repetitive lines too, share a key; lines of other words do not."""
    draw = random.Random(3)
    for n in [20, 100, 150, 160, 170, 200, 214, 225, 300, 3000]:
        line = "".join(draw.choice("abcdefgh ") for _ in range(n))
        for other in (line[: n - n // 6], line + line, "x" + line[1:]):
            sets = [set(hashing.char_shingles([x], op.WIDTH)[0].tolist()) for x in (line, other)]
            if 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]):
                of, keys = op._line_keys([line, other])
                assert set(keys[of == 0].ravel().tolist()) & set(keys[of == 1].ravel().tolist())
    # Repetitive lines are long but have few shingles: bins that are empty do not bring them together.
    of, keys = op._line_keys(["ab" * 400, "cd" * 400])
    assert not set(keys[of == 0].ravel().tolist()) & set(keys[of == 1].ravel().tolist())


def test_sketches_reject_no_similar_pair():
    draw = np.random.default_rng(2)
    rejected = 0
    for n in (1, 2, 7, 8, 60, 300, 5000):
        for share in (0.3, 0.6, 0.84, 0.86, 0.9, 1.0):
            own = draw.integers(0, 1 << 63, size=2 * n, dtype=np.uint64)
            cut = n - int(share * n)
            x, y = np.unique(own[:n]), np.unique(own[cut : cut + n])
            k = hashing.sketches([x, y])
            different = int(np.bitwise_count(k[0] ^ k[1]).sum())
            assert different <= len(np.setxor1d(x, y))
            possible = bool(op._close(np.int64(different), np.int64(len(x) + len(y))))
            similar = 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
            assert op._alike(x, y) == similar and (possible or not similar)
            rejected += not possible
    assert rejected >= 10
