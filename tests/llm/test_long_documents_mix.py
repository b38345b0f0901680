import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestar.llm import mixing


def miss(lengths, counts, budget):
    lengths, counts = np.array(lengths), np.array(counts)
    take = mixing.fit_budget(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    return int((lengths * take).sum()) - budget


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "want"),
    [([20_000], [3], 15_000, 5_000), ([20_000], [3], 9_000, -9_000), ([300_000], [2], 180_000, 120_000), ([300_000], [2], 140_000, -140_000), ([300_000, 400_000], [1, 1], 190_000, 110_000), ([7_000, 20_000], [1, 2], 18_000, 2_000)],
)
def test_few_long_documents_by_hand(lengths, counts, budget, want):
    assert miss(lengths, counts, budget) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60_000), st.integers(1, 2), min_size=1, max_size=5), st.floats(0, 1))
def test_table_finds_the_nearest_sum(counts, share):
    lengths = sorted(counts)
    budget = min(int(share * sum(k * n for k, n in counts.items())), mixing.DP_BUDGET)
    sums = {0}
    for k, n in counts.items():
        sums = {s + j * k for s in sums for j in range(n + 1)}
    assert abs(miss(lengths, [counts[k] for k in lengths], budget)) == min(abs(s - budget) for s in sums)
