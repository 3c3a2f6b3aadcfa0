"""Assignments against all permutations."""

import itertools

import numpy as np

from litlens.operators import matching


def test_assign_like_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        g = rng.integers(0, rng.choice([2, 4, 50]), size=(n, n))
        want = max(itertools.permutations(range(n)), key=lambda p: (sum(g[i, p[i]] for i in range(n)), [-x for x in p]))
        assert tuple(matching.assign(g)) == want


def test_parts_are_solved_apart(spark):
    cells = [("a", 1, 5), ("a", 2, 4), ("b", 1, 5), ("c", 7, 3), ("c", 8, 9), ("d", 8, 2)]
    got = matching.optimal_mapping(spark.createDataFrame(cells, "label string, cluster_id int, n long"))
    assert sorted(map(tuple, got.collect())) == [("a", 2, 4), ("b", 1, 5), ("c", 8, 9)]
    assert matching.optimal_mapping(spark.createDataFrame([], "label string, cluster_id int, n long")).count() == 0
