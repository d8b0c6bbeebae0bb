"""Core points and components of the core graph, exactly, by density tiles.

Tiles have side eps / sqrt(d), less a margin, so that all points of a tile are each
other's neighbours. A tile with ``min_pts`` points has core points only, without a
distance; distances are taken for points of the other tiles, of which each has fewer
than ``min_pts``. All core points of a tile are in one cluster, so that the graph to
be connected has a node for each tile:

1. tiles that a few of their extreme points show to be near are linked;
2. where that does not connect two near tiles, points close to the other tile's box
   are compared.

No list of neighbours is made of a dense region: its work grows with its points, not
with their pairs. Joins are by tile; a hot tile is split by AQE, as the other side has
few rows for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import squared_distance, tile
from gridloom.lineage import cut
from gridloom.operators.components import connected
from gridloom.operators.neighbors import TILED, neighbor_pairs, offsets, spread, tile_axes
from gridloom.params import Params

#: Tiles that a neighbour can be away, on each of up to three dimensions.
REACH = 2


def side(params: Params, dims: int) -> float:
    return params.eps32 / math.sqrt(dims) * 0.999


def tiled(points: DataFrame, params: Params, dims: int) -> DataFrame:
    return points.select("id", "coords", tile(F.col("coords"), side(params, dims), range(dims)).alias("tile"))


def core_points(points: DataFrame, params: Params, dims: int) -> DataFrame:
    """(id, coords, is_core) of every point; with the tile where there are up to three dimensions."""
    if dims > TILED:
        counts = neighbor_pairs(points, params, dims).groupBy("a").agg(F.count("*").alias("n"))
        return points.join(counts, points.id == counts.a).select("id", "coords", (F.col("n") >= params.min_pts).alias("is_core"))
    rows = tiled(points, params, dims)
    sizes = rows.groupBy("tile").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "tile")
    sparse = rows.where(F.col("size") < params.min_pts)
    near = spread(sparse.select("id", "coords", "tile"), "tile", dims, REACH)
    left = near.select(F.col("id").alias("a"), F.col("coords").alias("ca"), "near")
    right = rows.select(F.col("coords").alias("cb"), F.col("tile").alias("at"))
    met = left.join(right, (F.col("near") == F.col("at")) & (squared_distance(F.col("ca"), F.col("cb"), dims) <= params.eps2))
    counts = met.groupBy("a").agg(F.count("*").alias("n"))
    dense = rows.where(F.col("size") >= params.min_pts).select("id", "coords", "tile", F.lit(True).alias("is_core"))
    decided = sparse.join(counts, sparse.id == counts.a).select("id", "coords", "tile", (F.col("n") >= params.min_pts).alias("is_core"))
    return dense.unionByName(decided)


def _summaries(core: DataFrame, dims: int) -> DataFrame:
    """(tile, rep, low, high, some): a tile's least core id, its box, and its extreme points."""
    c = F.col("coords")
    ends = [f("coords", F.struct(c[i], "id")) for i in range(dims) for f in (F.min_by, F.max_by)]
    return core.groupBy("tile").agg(
        F.min("id").alias("rep"),
        F.array(*(F.min(c[i]) for i in range(dims))).alias("low"),
        F.array(*(F.max(c[i]) for i in range(dims))).alias("high"),
        F.array_distinct(F.array(*ends)).alias("some"),
    )


def _to_box(coords: Column, low: Column, high: Column, dims: int) -> Column:
    """Squared distance of a point to a box."""
    out = F.lit(0.0)
    for i in range(dims):
        d = F.greatest(low[i] - coords[i], coords[i] - high[i], F.lit(0.0))
        out = out + d * d
    return out


def _gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column, dims: int) -> Column:
    """Squared distance of two boxes."""
    out = F.lit(0.0)
    for i in range(dims):
        d = F.greatest(a_low[i] - b_high[i], b_low[i] - a_high[i], F.lit(0.0))
        out = out + d * d
    return out


def core_components(flagged: DataFrame, params: Params, dims: int, apart: int = 0) -> DataFrame:
    """(id, coords, root) of the core points: root is the least core id of the component; with the tile as in ``core_points``.

    Up to three dimensions, a tile may have ``apart`` more numbers: points that differ in these are no neighbours.
    """
    core = flagged.where("is_core")
    if dims > TILED:
        pairs = neighbor_pairs(core.select("id", "coords"), params, dims).where("a < b")
        found = connected(pairs, params.merge)
        return core.join(found, core.id == found.node, "left").select("id", "coords", F.coalesce("root", "id").alias("root"))
    tiles = cut(_summaries(core, dims))
    half = [o for o in offsets(dims, REACH) if o > (0,) * dims]
    steps = F.array(*(F.array(*(F.lit(x).cast("long") for x in o + (0,) * apart)) for o in half))
    left = tiles.select("tile", "rep", "low", "high", "some", F.explode(F.transform(steps, lambda s: F.zip_with("tile", s, lambda a, b: a + b))).alias("near"))
    right = tiles.select(*(F.col(c).alias(f"{c}2") for c in tiles.columns))
    margin = params.eps2 * 1.000001  # of boxes only: points decide
    near = left.join(right, (F.col("near") == F.col("tile2")) & (_gap(F.col("low"), F.col("high"), F.col("low2"), F.col("high2"), dims) <= margin))
    shown = F.exists("some", lambda a: F.exists("some2", lambda b: squared_distance(a, b, dims) <= params.eps2))
    near = cut(near.select("tile", "rep", "low", "high", "tile2", "rep2", "low2", "high2", shown.alias("shown")))
    found = connected(near.where("shown").select(F.col("rep").alias("a"), F.col("rep2").alias("b")), params.merge)
    roots = tiles.select("tile", "rep").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"))
    roots = cut(roots)
    open_ = near.where("not shown").join(roots, "rep").join(roots.select(F.col("rep").alias("rep2"), F.col("root").alias("root2")), "rep2").where("root != root2")
    open_ = cut(open_)
    if not open_.isEmpty():
        a = core.select("tile", F.col("coords").alias("ca")).join(open_, "tile").where(_to_box(F.col("ca"), F.col("low2"), F.col("high2"), dims) <= margin)
        a = a.select("rep", "rep2", "root", "root2", "ca")
        b = core.select(F.col("tile").alias("tile2"), F.col("coords").alias("cb")).join(open_, "tile2").where(_to_box(F.col("cb"), F.col("low"), F.col("high"), dims) <= margin)
        b = b.select(F.col("rep").alias("r"), F.col("rep2").alias("r2"), "cb")
        touch = a.join(b, (F.col("rep") == F.col("r")) & (F.col("rep2") == F.col("r2")) & (squared_distance(F.col("ca"), F.col("cb"), dims) <= params.eps2))
        more = connected(touch.select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct(), params.merge)
        more = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
        roots = roots.join(more, F.col("root") == F.col("old"), "left").select("rep", F.coalesce("new", "root").alias("root"))
    named = tiles.select("tile", "rep").join(roots, "rep").select("tile", "root")
    return core.join(named, "tile").select("id", "coords", "tile", "root")


def touching(flagged: DataFrame, rooted: DataFrame, params: Params, dims: int, apart: int = 0) -> DataFrame:
    """(id, core, root): core points within eps of each point that is not core; ``apart`` as in ``core_components``."""
    other = flagged.where(~F.col("is_core"))
    g = min(dims, TILED)
    if dims > TILED:
        step, axes = params.eps32 * 1.0001, tile_axes(flagged, dims)
        other = other.withColumn("tile", tile(F.col("coords"), step, axes))
        rooted = rooted.withColumn("tile", tile(F.col("coords"), step, axes))
    near = spread(other.select("id", "coords", "tile"), "tile", g, REACH if dims <= TILED else 1, apart=apart)
    left = near.select("id", F.col("coords").alias("ca"), "near")
    right = rooted.select(F.col("id").alias("core"), F.col("coords").alias("cb"), F.col("tile").alias("at"), "root")
    return left.join(right, (F.col("near") == F.col("at")) & (squared_distance(F.col("ca"), F.col("cb"), dims) <= params.eps2)).select("id", "core", "root")
