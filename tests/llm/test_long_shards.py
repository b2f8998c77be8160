"""Bin completion on shards of many sequences."""

import numpy as np

from sparkveil.llm import packing as P

SET = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]


def test_long_shard_is_packed_as_well_as_a_short_one():
    for repeats in (100, 2500):
        sizes = sorted([68 * n for n in SET] * repeats, reverse=True)
        bins = P.bin_completion(sizes, 4096)
        assert len(bins) == 3 * repeats < len(P.best_fit_decreasing(sizes, 4096))
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 4096 for b in bins)


def fewest(sizes, capacity):
    """Fewest bins, by dynamic programming over subsets."""
    best = [(len(sizes) + 1, 0)] * (1 << len(sizes))
    best[0] = (0, capacity)
    for s in range(1 << len(sizes)):
        n, used = best[s]
        for k, x in enumerate(sizes):
            if not s >> k & 1:
                t = s | 1 << k
                best[t] = min(best[t], (n, used + x) if used + x <= capacity else (n + 1, x))
    return best[-1][0]


def test_small_sets_take_the_fewest_bins():
    rng = np.random.default_rng(20)
    for _ in range(60):
        sizes = sorted(rng.integers(1, 40, 10).tolist(), reverse=True)
        assert len(P.bin_completion(sizes, 60)) == fewest(sizes, 60)
