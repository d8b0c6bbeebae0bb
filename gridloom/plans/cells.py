"""Clustering step by step over grid cells: local clusters, merge edges, global labels.

The steps show how clusters of cells are put together. In :class:`Cells`, core flags are exact
before any cell is looked at, so that copies never have a status of their own, and the result is
that of :func:`gridloom.plans.clustering.density_clusters`, which is the way for large inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import tile
from gridloom.lineage import cut
from gridloom.operators import components as graph
from gridloom.operators.density import core_components, core_points, side, touching
from gridloom.operators.grid import Grid, copies, grid_of
from gridloom.operators.neighbors import TILED
from gridloom.params import Params
from gridloom.plans.clustering import density_clusters
from gridloom.sources.points import dimensions


def key(cell_id: Column, local_root: Column) -> Column:
    """The name of a local cluster."""
    return F.concat_ws("_", cell_id.cast("string"), local_root.cast("string"))


def each_alone(points: DataFrame, params: Params) -> DataFrame:
    """(cell_id, id, is_home, is_core, local_root): every cell's copies clustered by themselves, as if there were no other cell.

    Neighbours are counted among the copies of a cell only, so that a copy far from its home
    can lose its core status there. Cells are kept apart by one more coordinate, in which
    they lie further from each other than any neighbour; so no cell has to fit into a task.
    ``local_root`` is the least core id of the cell's cluster, null for noise.
    """
    grid = grid_of(points, params)
    if grid is None:
        return points.sparkSession.createDataFrame([], "cell_id long, id long, is_home boolean, is_core boolean, local_root long")
    if math.prod(grid.shape) >= 1 << 50:
        raise OverflowError("the grid has more cells than can be told apart")
    held = cut(copies(points, grid).select(F.struct("id", "cell_id").alias("id"), F.concat("coords", F.array(F.col("cell_id") * F.lit(8 * params.eps32))).alias("coords"), "is_home"))
    found = density_clusters(held.select("id", "coords"), replace(params, border_mode="standard"), dims=grid.dims + 1)
    found = found.select("id", "is_core", F.col("root.id").alias("local_root"))
    return held.select("id", "is_home").join(found, "id").select("id.cell_id", "id.id", "is_home", "is_core", "local_root")


@dataclass
class Cells:
    """The steps for one set of points, which has at least one."""

    points: DataFrame
    params: Params

    @cached_property
    def dims(self) -> int:
        found = dimensions(self.points)
        if found is None:
            raise ValueError("there are no points")
        return found

    @cached_property
    def grid(self) -> Grid:
        return grid_of(self.points, self.params)

    @cached_property
    def flagged(self) -> DataFrame:
        return cut(core_points(self.points, self.params, self.dims).select("id", "coords", "is_core"))

    @cached_property
    def places(self) -> DataFrame:
        """(place, coords, is_core): distinct coordinates, under the least id that has them. Points that lie on each other share all that follows."""
        return cut(self.flagged.groupBy("coords").agg(F.min("id").alias("place"), F.bool_or("is_core").alias("is_core")))

    def expanded(self, rows: DataFrame) -> DataFrame:
        """Rows of places (column ``place``), once for each of their points (column ``id``)."""
        members = self.flagged.join(self.places.select("coords", "place"), "coords").select("id", "place")
        return members.join(rows, "place").drop("place")

    @cached_property
    def place_copies(self) -> DataFrame:
        """(place, coords, cell_id, is_home, is_core)."""
        found = copies(self.places.select(F.col("place").alias("id"), "coords"), self.grid).select(F.col("id").alias("place"), "coords", "cell_id", "is_home")
        return cut(found.join(self.places.select("place", "is_core"), "place"))

    @property
    def copies(self) -> DataFrame:
        """(id, cell_id, is_home, is_core)."""
        return self.expanded(self.place_copies.select("place", "cell_id", "is_home", "is_core"))

    @cached_property
    def local_places(self) -> DataFrame:
        """(cell_id, place, is_home, is_core, local_root): core copies with their component inside the cell.

        Copies of places that are not core have a row for each local cluster that they
        touch, and one with a null root where they touch none. Tiles are those of
        :mod:`gridloom.operators.density`, with the cell as one more number, so that no
        list of pairs is made of a dense cell; beyond three dimensions, which have no such
        tiles, cells are kept apart by one more coordinate.
        """
        dims, c = self.dims, F.col("coords")
        params = replace(self.params, merge="distributed" if self.params.merge == "distributed" else "auto")  # the driver's room is for the merge
        rows = self.place_copies.withColumn("id", F.struct("cell_id", "place"))
        if apart := int(dims <= TILED):
            rows = rows.withColumn("tile", F.concat(tile(c, side(params, dims), range(dims)), F.array("cell_id")))
        else:
            rows, dims = rows.withColumn("coords", F.concat(c, F.array(F.col("cell_id") * F.lit(8 * params.eps32)))), dims + 1
        rooted = cut(core_components(rows, params, dims, apart))
        core = rows.where("is_core").select("id", "is_home", "is_core").join(rooted.select("id", "root"), "id")
        met = touching(rows, rooted, params, dims, apart).select("id", "root").distinct()
        border = rows.where("not is_core").select("id", "is_home", "is_core").join(met, "id", "left")
        return cut(core.unionByName(border).select("id.cell_id", "id.place", "is_home", "is_core", F.col("root.place").alias("local_root")))

    @property
    def local(self) -> DataFrame:
        """(cell_id, id, is_home, is_core, local_root): the same of all points."""
        return self.expanded(self.local_places).select("cell_id", "id", "is_home", "is_core", "local_root")

    def keyed(self) -> DataFrame:
        """(key, place, is_home, is_core): copies of places in a local cluster, by its name."""
        return self.local_places.where("local_root is not null").select(key(F.col("cell_id"), F.col("local_root")).alias("key"), "place", "is_home", "is_core")

    def same_point_edges(self) -> DataFrame:
        """(a, b): local clusters of different cells that a core point has copies in; a star for each point."""
        core = self.keyed().where("is_core").select("place", "key")
        least = core.groupBy("place").agg(F.min("key").alias("a"))
        return core.join(least, "place").where("key != a").select("a", F.col("key").alias("b")).distinct()

    @cached_property
    def merged(self) -> DataFrame:
        """(key, root): components of local clusters; those without an edge are their own."""
        nodes = self.keyed().select(F.col("key").alias("node"))
        return cut(graph.with_isolated(graph.connected(self.same_point_edges(), self.params.merge), nodes).withColumnRenamed("node", "key"))

    @cached_property
    def global_ids(self) -> DataFrame:
        """(key, cluster_id): components numbered from 1 by their least core id."""
        first = self.keyed().where("is_core").groupBy("key").agg(F.min("place").alias("place"))
        named = self.merged.join(first, "key").groupBy(F.col("root").alias("component")).agg(F.min("place").alias("root"))
        numbers = graph.numbered_roots(named)
        return cut(self.merged.join(named.withColumnRenamed("root", "least"), F.col("root") == F.col("component")).join(numbers.withColumnRenamed("root", "least"), "least").select("key", "cluster_id"))

    def point_to_global(self) -> DataFrame:
        """(id, cluster_id): the cluster of a point's core copies, else the least of its other copies', else -1."""
        met = self.keyed().join(self.global_ids, "key")
        best = met.groupBy("place").agg(F.min(F.when(F.col("is_core"), F.col("cluster_id"))).alias("core"), F.min(F.when(~F.col("is_core"), F.col("cluster_id"))).alias("border"))
        rows = self.places.select("place").join(best, "place", "left").select("place", F.coalesce("core", "border", F.lit(-1)).alias("cluster_id"))
        return self.expanded(rows).select("id", "cluster_id")
