from __future__ import annotations

import numpy as np
import pytest

from gridloom import Params
from gridloom.operators import counts, neighbors
from tests import brute
from tests.data import frame

SIX = [(2, 3), (5, 4), (9, 6), (4, 7), (8, 1), (7, 2)]


def test_radius_search(spark):
    points = frame(spark, SIX)
    assert [r.id for r in neighbors.radius_search(points, [5, 5], 3**0.5, 2).collect()] == [1]
    assert sorted((r.id, r.d2) for r in neighbors.radius_search(points, [6, 3], 2.5, 2).collect()) == [(1, 2.0), (5, 2.0)]


def test_a_point_is_its_own_neighbour(spark):
    points = frame(spark, [(0.2, 0.2), (0.25, 0.2), (0.2, 0.25), (0.25, 0.25), (0.7, 0.7)])
    assert sorted((r.id, r.neighbors) for r in neighbors.neighbor_counts(points, Params(0.12, 2), 2).collect()) == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 1)]


def test_pairs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    for dims, eps in ((1, 0.01), (2, 0.08), (3, 0.2), (5, 0.5), (12, 1.2)):
        data = (rng.random((150, dims)) * 2 - 1).tolist()
        p = Params(eps, 3)
        near = brute.neighbours(data, p)
        pairs = sorted((r.a, r.b) for r in neighbors.neighbor_pairs(frame(spark, data), p, dims).collect())
        assert pairs == sorted(zip(*map(list, np.nonzero(near))))
        some = neighbors.pairwise_distance(frame(spark, data), p, dims).collect()
        assert sorted((r.a, r.b) for r in some) == [x for x in pairs if x[0] < x[1]]
        assert all(r.d2 <= p.eps2 for r in some)


@pytest.mark.parametrize(("dims", "eps"), [(2, 0.2), (12, 1.3)])
def test_counts_list_no_pairs(spark, monkeypatch, dims, eps):
    """Counts are right where places repeat and blocks are small, and no pair has a row."""
    rng = np.random.default_rng(3)
    data = (rng.integers(-4, 5, (60, dims)) / 4).tolist() * 3 + (rng.random((60, dims)) * 2 - 1).tolist()
    p = Params(eps, 3)
    monkeypatch.setattr(neighbors, "neighbor_pairs", None)
    got = {r.id: r.neighbors for r in neighbors.neighbor_counts(frame(spark, data), p, dims).collect()}
    assert got == dict(enumerate(np.sum(brute.neighbours(data, p), axis=1).tolist()))


def test_sums_in_doubt_are_exact():
    rng = np.random.default_rng(4)
    for scale, shift in ((1, 0), (1, 1e6), (1e30, 0)):
        a, b = (rng.integers(-1, 2, (n, 16)) * scale + shift for n in (300, 70))
        a, b, eps2 = a.astype(float), b.astype(float), 20.0 * scale * scale  # many lie on the radius itself
        near = ((a[:, None] - b[None]) ** 2).cumsum(axis=2)[:, :, -1] <= eps2
        of_a, of_b = counts.compared(a, np.arange(300.0), b, np.ones(70), eps2)
        assert of_a.tolist() == near.sum(axis=1).tolist() and of_b.tolist() == (np.arange(300.0) @ near).tolist()


def test_a_distance_is_taken_once_for_two_places(spark):
    points = frame(spark, [(0.5, 0.5)] * 1500 + [(0.51, 0.5)] * 40)
    near, _ = neighbors._near_lists(points, Params(0.1, 3), 2)
    assert near.count() <= 16
    assert neighbors.neighbor_pairs(points, Params(0.1, 3), 2).count() == 1540**2
    assert neighbors.pairwise_distance(points, Params(0.1, 3), 2).count() == 1540 * 1539 // 2


def test_no_points(spark):
    assert neighbors.neighbor_pairs(frame(spark, []), Params(), 2).collect() == []
    assert neighbors.neighbor_counts(frame(spark, []), Params(), 2).collect() == []
