from __future__ import annotations

import numpy as np
import pytest

from gridloom import Params, density_clusters
from gridloom.operators import density
from gridloom.operators.components import UnionFind
from gridloom.plans import summary
from gridloom.plans.cells import Cells, each_alone
from tests import brute
from tests.data import BOWS, frame


def clusters(spark, points, params):
    return [r.cluster_id for r in density_clusters(frame(spark, points), params).orderBy("id").collect()]


FIXTURES = [
    ([(0, 0), (0.1, 0.1), (0.2, 0), (10, 10), (10.1, 10.1), (10.2, 10), (50, 50)], Params(0.5, 2), [1, 1, 1, 2, 2, 2, -1]),
    ([(0.1, 0.1), (1.9, 0.1), (2.1, 0.1), (4.0, 4.0)], Params(1, 2, 2, 1), [-1, 1, 1, -1]),
    ([(0.2, 0.2), (0.25, 0.2), (0.2, 0.25), (0.25, 0.25), (0.7, 0.7)], Params(0.12, 2), [1, 1, 1, 1, -1]),
    (BOWS, Params(0.15, 2), [1, 1, 1, 2, 2, 2, 2, -1, 3, 3, 3, 3, 3, 3, 3, 4, 4]),
    (BOWS, Params(0.18, 3), [1, 1, 1, 1, 1, 1, 1, -1, 2, 2, 2, 2, 2, 2, 2, -1, -1]),
]


@pytest.mark.parametrize(("points", "params", "want"), FIXTURES)
def test_fixtures(spark, points, params, want):
    assert clusters(spark, points, params) == want == brute.labels(points, params)[0]


def test_points_that_a_scan_leaves_out(spark):
    points = [(0, 0), (2.7, 0), (1.8, 0), (0.9, 0), (3.6, 0)]
    assert clusters(spark, points, Params(1, 3)) == [1, 1, 1, 1, 1]
    assert clusters(spark, points, Params(1, 3, border_mode="visit_order")) == [-1, 1, 1, 1, 1] == brute.visited(points, Params(1, 3))


def cloud(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.random((6, dims)) * 2 - 1
    near = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, dims))
    data = np.concatenate([near, rng.random((n // 3, dims)) * 2 - 1, near[: n // 6]])
    return rng.permutation(data).tolist()


@pytest.mark.parametrize(("seed", "n", "dims", "eps", "min_pts"), [(1, 150, 2, 0.06, 4), (2, 200, 2, 0.03, 3), (3, 150, 2, 0.2, 25), (4, 150, 3, 0.1, 5), (5, 100, 1, 0.01, 3), (6, 120, 3, 0.3, 30), (7, 100, 7, 0.35, 6), (8, 60, 2, 0.05, 1)])
def test_labels_are_those_of_brute_force(spark, seed, n, dims, eps, min_pts):
    points = cloud(seed, n, dims)
    want, core = brute.labels(points, Params(eps, min_pts))
    rows = density_clusters(frame(spark, points).repartition(5), Params(eps, min_pts)).orderBy("id").collect()
    assert [r.cluster_id for r in rows] == want
    assert [r.is_core for r in rows] == core
    assert clusters(spark, points, Params(eps, min_pts, merge="driver")) == want
    assert clusters(spark, points, Params(eps, min_pts, border_mode="visit_order")) == brute.visited(points, Params(eps, min_pts))


def test_near_tiles_whose_extremes_are_far(spark):
    """Two dense arcs that come within eps only at inner points: extremes do not show it."""
    t = np.linspace(-1, 1, 41)
    left = np.stack([-0.3 * t**2, 0.3 * t], axis=1)
    right = np.stack([0.145 + 0.3 * t**2, 0.3 * t + 0.02], axis=1)
    points = np.concatenate([left, right]).tolist()
    for eps in (0.12, 0.14, 0.145, 0.15, 0.2, 0.4):
        assert clusters(spark, points, Params(eps, 3)) == brute.labels(points, Params(eps, 3))[0]


def test_one_place_holds_most_points(spark):
    points = [(0.5, 0.5)] * 400 + [(0.5 + k * 0.01, 0.5) for k in range(30)] + [(0.9, 0.9)]
    params = Params(0.011, 5)
    assert clusters(spark, points, params) == brute.labels(points, params)[0]


def test_tiles_hold_only_neighbours(spark):
    rng = np.random.default_rng(9)
    for dims in (1, 2, 3):
        p = Params(0.3, 3)
        data = (rng.random((300, dims)) * 2 - 1).tolist()
        tiles = {}
        for r in density.tiled(frame(spark, data), p, dims).collect():
            tiles.setdefault(tuple(r.tile), []).append(r.id)
        near = brute.neighbours(data, p)
        assert all(near[np.ix_(ids, ids)].all() for ids in tiles.values())


def test_nothing_and_one(spark):
    assert density_clusters(frame(spark, []), Params(), dims=2).collect() == []
    assert clusters(spark, [], Params()) == []
    assert clusters(spark, [(1, 2)], Params(1, 1)) == [1]
    assert clusters(spark, [(1, 2)], Params(1, 2)) == [-1]


@pytest.mark.parametrize(("factor", "merge"), [(1, "distributed"), (2, "driver"), (3, "distributed")])
def test_cells_come_to_the_same_labels(spark, factor, merge):
    points = cloud(11, 120, 2)
    params = Params(0.07, 4, cell_factor=factor, merge=merge)
    rows = Cells(frame(spark, points), params).point_to_global().orderBy("id").collect()
    assert [r.cluster_id for r in rows] == brute.labels(points, params)[0]


@pytest.mark.parametrize(("dims", "eps"), [(1, 0.02), (2, 0.07), (3, 0.15), (4, 0.3)])
def test_local_clusters_are_those_of_brute_force(spark, dims, eps):
    points, params = cloud(17, 90, dims), Params(eps, 4, cell_factor=2)
    near, core = brute.neighbours(points, params), brute.labels(points, params)[1]
    cells = Cells(frame(spark, points), params)
    held, got = {}, {}
    for r in cells.copies.collect():
        held.setdefault(r.cell_id, []).append(r.id)
    for r in cells.local.collect():
        got.setdefault((r.cell_id, r.id), set()).add(r.local_root)
    want = {}
    for cell, ids in held.items():
        inner = [i for i in ids if core[i]]
        root = dict(UnionFind.of([(i, j) for i in inner for j in inner if near[i][j]]).roots())
        for i in ids:
            want[cell, i] = {root[i]} if core[i] else {root[j] for j in inner if near[i][j]} or {None}
    assert got == want


def test_the_drivers_room_is_not_for_pairs(spark):
    """A cell of 1500 points on one place and 500 around it: more pairs than the driver takes edges."""
    points = [(0.5, 0.5)] * 1500 + [(0.5 + k * 1e-5, 0.5) for k in range(500)] + [(0.9, 0.9)]
    rows = Cells(frame(spark, points), Params(0.1, 5, merge="driver")).merged.collect()
    assert len({r.root for r in rows}) == 1


@pytest.mark.parametrize("step", ["keys", "edges", "local", "labels"])
def test_cells_list_no_pairs(spark, monkeypatch, step):
    from gridloom.plans import cells as module

    def refuse(*_):
        raise AssertionError("pairs of a dense cell")

    monkeypatch.setattr(module, "neighbor_pairs", refuse, raising=False)
    monkeypatch.setattr("gridloom.operators.density.neighbor_pairs", refuse)
    cells = Cells(frame(spark, BOWS * 3), Params(0.18, 3))
    if step == "keys":
        assert cells.keyed().select("key").distinct().count() > 1
    elif step == "edges":
        assert {r.a < r.b for r in cells.same_point_edges().collect()} == {True}
    elif step == "local":
        assert {r.id for r in cells.local.collect()} == set(range(51))
    else:
        assert [r.cluster_id for r in cells.point_to_global().orderBy("id").collect()] == brute.labels(BOWS * 3, Params(0.18, 3))[0]


def test_each_cell_alone(spark):
    points, params = cloud(13, 150, 2), Params(0.07, 5, cell_factor=2)
    rows = each_alone(frame(spark, points), params).collect()
    cells = {}
    for r in rows:
        cells.setdefault(r.cell_id, []).append(r)
    assert sum(r.is_home for r in rows) == len(points) and len(cells) > 20
    for members in cells.values():
        members.sort(key=lambda r: r.id)
        labels, core = brute.labels([points[r.id] for r in members], params)
        assert [r.is_core for r in members] == core
        roots = {}
        for r, label in zip(members, labels):
            assert (r.local_root is None) == (label < 0)
            if label > 0:
                assert roots.setdefault(label, r.local_root) == r.local_root
        assert len(set(roots.values())) == len(roots)
    assert each_alone(frame(spark, []), params).collect() == []


def test_summary(spark):
    labelled, row = summary.run(frame(spark, BOWS), Params(0.18, 3), "r1", "bows")
    row = row.first()
    assert (row.total_points, row.num_clusters, row.core_points, row.noise_points, row.border_points) == (17, 2, 10, 3, 4)
    assert labelled.count() == 17 and row.cluster_seconds > 0 and row.read_seconds > 0
    assert row.neighbor_queries == 17 and 0 < row.neighbor_percent <= 100 and row.neighbor_seconds > 0 and row.stages > 0 and row.tasks >= row.stages and row.shuffle_write_mb >= 0
    some = summary.preview(frame(spark, BOWS), Params(0.18, 3), 4)
    assert {name: len(rows) for name, rows in some.items()} == {"copies": 4, "core_flags": 4, "local_clusters": 4, "merge_edges": 4, "components": 4, "labels": 4}
    empty, none = summary.run(frame(spark, []), Params(0.18, 4))
    assert empty.collect() == [] and none.first().total_points == 0
