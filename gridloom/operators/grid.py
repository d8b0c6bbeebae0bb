"""The uniform grid: bounds, cells, and copies of points near a cell's edge."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.params import Params
from gridloom.sources.points import dimensions


@dataclass(frozen=True)
class Grid:
    """Cells of a side, from a lower corner on."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    size: float
    buffer: float

    @property
    def dims(self) -> int:
        return len(self.low)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(math.ceil((b - a) / self.size) + 1 for a, b in zip(self.low, self.high))

    def home(self, coords: Column) -> Column:
        """The home cell, clamped to the grid."""
        return F.array(*(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((coords[i] - F.lit(a)) / F.lit(self.size)))).cast("int") for i, (a, n) in enumerate(zip(self.low, self.shape))))

    def number(self, cell: Column) -> Column:
        """Row-major number of a cell, the last dimension fastest."""
        if math.prod(self.shape) >= 1 << 63:
            raise OverflowError("the grid has more cells than a long can number")
        out = F.lit(0).cast("long")
        for i, n in enumerate(self.shape):
            out = out * n + cell[i]
        return out

    def steps(self, coords: Column, cell: Column, i: int) -> Column:
        """Array of the steps, of -1, 0 and 1 along one dimension, to cells whose edge is within the buffer."""
        corner = F.lit(self.low[i]) + cell[i] * F.lit(self.size)
        down = (cell[i] > 0) & (coords[i] - corner <= self.buffer)
        up = (cell[i] < self.shape[i] - 1) & (corner + F.lit(self.size) - coords[i] <= self.buffer)
        return F.concat(F.array(F.lit(0)), F.when(down, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.when(up, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))


def bounds(points: DataFrame, dims: int | None = None) -> DataFrame:
    """One row: n and the least and greatest coordinate of each dimension, in one pass."""
    dims = dims or dimensions(points) or 0
    sides = [f(F.col("coords")[i]).alias(f"{name}_{i}") for i in range(dims) for name, f in (("min", F.min), ("max", F.max))]
    return points.agg(F.count("*").alias("n"), *sides)


def grid_of(points: DataFrame, params: Params) -> Grid | None:
    """The grid over the points; None without any."""
    dims = dimensions(points)
    if dims is None:
        return None
    row = bounds(points, dims).first()
    return Grid(tuple(row[f"min_{i}"] for i in range(dims)), tuple(row[f"max_{i}"] for i in range(dims)), params.cell_size, params.buffer)


def home_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """(id, coords, cell, cell_id)."""
    return points.withColumn("cell", grid.home(F.col("coords"))).withColumn("cell_id", grid.number(F.col("cell")))


def copies(points: DataFrame, grid: Grid) -> DataFrame:
    """(id, coords, cell, cell_id, is_home): each point in its home cell and in the adjacent cells it is near to.

    The steps of each dimension are pruned before they are combined, so that a point
    far from all edges makes one row, not one for each neighbour.
    """
    rows = points.withColumn("home", grid.home(F.col("coords")))
    cells = F.array(F.array().cast("array<int>"))
    for i in range(grid.dims):
        steps = grid.steps(F.col("coords"), F.col("home"), i)
        cells = _combined(cells, steps, F.col("home")[i])
    rows = rows.select("id", "coords", "home", F.explode(cells).alias("cell"))
    return rows.select("id", "coords", "cell", grid.number(F.col("cell")).alias("cell_id"), (F.col("cell") == F.col("home")).alias("is_home"))


def _combined(cells: Column, steps: Column, home: Column) -> Column:
    """Each of the partial cells with each step of one more dimension."""
    return F.flatten(F.transform(cells, lambda c: F.transform(steps, lambda s: F.concat(c, F.array(home + s)))))
