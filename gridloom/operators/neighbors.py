"""Neighbours within a radius, by tiles of the plane instead of a product of all points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import squared_distance, tile
from gridloom.params import Params

#: Dimensions that tiles are cut on: points near in all dimensions are near in some.
TILED = 3


def tile_axes(points: DataFrame, dims: int) -> list[int]:
    """The dimensions that tiles are cut on: all, or the ones along which the points spread most."""
    if dims <= TILED:
        return list(range(dims))
    wide = points.agg(*(F.stddev_pop(F.col("coords")[i]) for i in range(dims))).first()
    return sorted(sorted(range(dims), key=lambda i: (-(wide[i] or 0.0), i))[:TILED])


def offsets(dims: int, reach: int) -> list[tuple[int, ...]]:
    return list(product(range(-reach, reach + 1), repeat=dims))


def spread(df: DataFrame, cell: str, dims: int, reach: int, out: str = "near", apart: int = 0) -> DataFrame:
    """Each row once for each tile that is up to ``reach`` tiles away; the last ``apart`` numbers of a tile stay."""
    steps = F.array(*(F.array(*(F.lit(o).cast("long") for o in off + (0,) * apart)) for off in offsets(dims, reach)))
    near = F.transform(steps, lambda s: F.zip_with(F.col(cell), s, lambda a, b: a + b))
    return df.withColumn(out, F.explode(near))


#: Points of one place that go as one list.
TOGETHER = 1024


def _listed(points: DataFrame) -> DataFrame:
    """(coords, ids): the points of each place, in lists of bounded size."""
    points = points.select("id", F.transform("coords", lambda x: x + F.lit(0.0)).alias("coords"))  # one zero
    sizes = points.groupBy("coords").agg(F.ceil(F.count("*") / TOGETHER).alias("lists"))
    rows = points.join(sizes, "coords")
    return rows.groupBy("coords", F.pmod(F.xxhash64("id"), F.col("lists")).alias("list")).agg(F.collect_list("id").alias("ids")).select("coords", "ids")


def _near_lists(points: DataFrame, params: Params, dims: int) -> tuple[DataFrame, Column]:
    """(as_, bs, ca, cb): lists of points whose places are within eps, and the squared distance of these.

    Tiles have side eps. One side of the join goes to the tiles around its own, the
    other to its own only, so that each pair meets in one tile. A distance is taken once for
    all points of two places.
    """
    axes = tile_axes(points, dims)
    tiled = _listed(points).withColumn("tile", tile(F.col("coords"), params.eps32 * 1.0001, axes))
    left = spread(tiled, "tile", len(axes), 1).select(F.col("ids").alias("as_"), F.col("coords").alias("ca"), "near")
    right = tiled.select(F.col("ids").alias("bs"), F.col("coords").alias("cb"), "tile")
    d2 = squared_distance(F.col("ca"), F.col("cb"), dims)
    return left.join(right, (F.col("near") == F.col("tile")) & (d2 <= params.eps2)), d2


def neighbor_pairs(points: DataFrame, params: Params, dims: int) -> DataFrame:
    """(a, b): every ordered pair of points within eps, each point with itself included."""
    near, _ = _near_lists(points, params, dims)
    return near.select("bs", F.explode("as_").alias("a")).select("a", F.explode("bs").alias("b"))


def pairwise_distance(points: DataFrame, params: Params, dims: int) -> DataFrame:
    """(a, b, d2): pairs a < b within eps and their squared distance."""
    near, d2 = _near_lists(points, params, dims)
    rows = near.where(F.array_min("as_") < F.array_max("bs")).select("bs", d2.alias("d2"), F.explode("as_").alias("a"))
    return rows.select("a", F.explode("bs").alias("b"), "d2").where("a < b")


def neighbor_counts(points: DataFrame, params: Params, dims: int) -> DataFrame:
    """(id, neighbors): points within eps of each point, itself included; no pair has a row."""
    from gridloom.operators import counts

    return counts.neighbor_counts(points, params, dims)


def radius_search(points: DataFrame, centre: list[float], radius: float, dims: int) -> DataFrame:
    """(id, d2): points within a radius of one place. Bounds of each coordinate are tested first."""
    where = F.array(*map(F.lit, map(float, centre)))
    d2: Column = squared_distance(F.col("coords"), where, dims)
    box = F.lit(True)
    for i, c in enumerate(centre):
        box = box & F.col("coords")[i].between(float(c) - radius, float(c) + radius)
    return points.where(box & (d2 <= radius * radius)).select("id", d2.alias("d2"))
