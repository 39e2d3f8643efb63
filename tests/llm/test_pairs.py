"""Bands of two paragraphs, which are most, take the short way, with the links of the long one."""

import numpy as np

from locusframe.llm import substring_dedup


def test_pairs_as_larger_groups(monkeypatch):
    rng = np.random.default_rng(5)
    far = rng.integers(-(2**62), 2**62, 30)
    for _ in range(200):
        whole = np.unique(rng.integers(-(2**62), 2**62, 40))
        a, b = (rng.permutation(whole)[: rng.integers(30, 41)] for _ in range(2))
        for asks in ([True, True], [True, False], [False, True], [False, False]):
            links = substring_dedup.jaccard_links([a, b, far], np.array([*asks, False]), 0.8)
            assert [set(x) for x in substring_dedup.jaccard_links([a, b], np.array(asks), 0.8)] == [set(x) for x in links], asks
    monkeypatch.setattr(substring_dedup.np, "argsort", None)  # the long way sorts all hashes of a group
    assert substring_dedup.jaccard_links([a, a], np.array([True, True]), 0.8) == [(0, 1)]
