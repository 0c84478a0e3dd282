"""What the pruning of candidate pairs may miss, against what it states."""

from math import comb

from traceloom.llm import candidates, op4_near_dedup


def test_pruning_misses_what_it_states_over_all_batches():
    """The chance of falling below the bound at any batch, counted path by path over the number of equal minima."""
    count = op4_near_dedup.MINIMA
    held, lost = {0: 1.0}, 0.0
    for enough in candidates.least_matches(count):
        after = {}
        for m, p in held.items():
            for k in range(candidates.BATCH + 1):
                after[m + k] = after.get(m + k, 0.0) + p * comb(candidates.BATCH, k) * 0.75**k * 0.25 ** (candidates.BATCH - k)
        lost += sum(p for m, p in after.items() if m < enough)
        held = {m: p for m, p in after.items() if m >= enough}
    assert 0 < lost <= candidates.MISS <= 1e-6
