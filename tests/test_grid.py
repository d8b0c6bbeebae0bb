from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Params
from gridloom.operators import grid
from tests.data import BOWS, frame


def test_copies_of_four_points(spark):
    points = frame(spark, [(0.1, 0.1), (1.9, 0.1), (2.1, 0.1), (4.0, 4.0)])
    g = grid.grid_of(points, Params(1, 2, 2, 1))
    assert g.shape == (3, 3)
    rows = grid.copies(points, g).collect()
    assert sorted((r.id, *r.cell) for r in rows if r.is_home) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1)]
    assert sorted((r.id, *r.cell) for r in rows if not r.is_home) == [(1, 1, 0), (2, 1, 0), (3, 1, 2), (3, 2, 1), (3, 2, 2)]


@pytest.mark.parametrize(("factor", "shape", "ghosts"), [(1, (8, 8), 118), (3, (4, 4), 22)])
def test_copies_of_two_bows(spark, factor, shape, ghosts):
    points = frame(spark, BOWS)
    g = grid.grid_of(points, Params(0.15, 2, factor, 1))
    assert g.shape == shape
    assert grid.copies(points, g).where(~F.col("is_home")).count() == ghosts


def test_every_neighbour_has_a_copy_in_the_home_cell(spark):
    rng = np.random.default_rng(5)
    data = rng.random((200, 3)).tolist()
    points = frame(spark, data)
    p = Params(0.17, 3, 1.5, 1)
    rows = grid.copies(points, grid.grid_of(points, p)).collect()
    home = {r.id: r.cell_id for r in rows if r.is_home}
    held = {(r.cell_id, r.id) for r in rows}
    assert len(held) == len(rows)
    c = np.asarray(data, np.float32).astype(float)
    for a in range(len(c)):
        for b in np.flatnonzero(((c - c[a]) ** 2).sum(axis=1) <= p.eps2):
            assert (home[a], b) in held


def test_cell_numbers_are_checked(spark):
    g = grid.Grid((0.0,) * 4, (1.0,) * 4, 1e-6, 1e-6)
    with pytest.raises(OverflowError):
        g.number(F.array(*map(F.lit, (0, 0, 0, 0))))


def test_no_points_have_no_grid(spark):
    assert grid.grid_of(frame(spark, []), Params()) is None


@pytest.mark.parametrize("bad", [{"eps": 0}, {"eps": float("nan")}, {"min_pts": 0}, {"min_pts": 1.5}, {"cell_factor": 1, "buffer_factor": 2}, {"buffer_factor": 0.5}, {"border_mode": "x"}, {"merge": "x"}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_the_radius_is_a_single():
    assert Params(0.03).eps2 == 8.999999845400453e-4
