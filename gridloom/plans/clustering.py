"""Density-based clusters: labels that do not depend on the order or partitioning of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.operators.components import numbered_roots
from gridloom.operators.density import core_components, core_points, touching
from gridloom.params import Params
from gridloom.sources.points import dimensions


def density_clusters(points: DataFrame, params: Params, flagged: DataFrame | None = None, dims: int | None = None) -> DataFrame:
    """(id, coords, is_core, root, cluster_id) of every point.

    ``root`` is the least core id of a point's cluster, null for noise. Clusters are
    numbered from 1 in the order of their roots; noise has cluster -1. ``flagged`` are the
    rows of :func:`core_points`, where they are known already; without ``dims`` the width
    of the first point is asked for.
    """
    dims = dims or dimensions(points)
    if dims is None:
        return points.select("id", "coords", F.lit(False).alias("is_core"), F.lit(None).cast("long").alias("root"), F.lit(-1).alias("cluster_id"))
    flagged = cut(core_points(points, params, dims)) if flagged is None else flagged
    rooted = cut(core_components(flagged, params, dims))
    met = touching(flagged, rooted, params, dims).groupBy("id").agg(F.min("root").alias("least"), F.min(F.when(F.col("core") == F.col("root"), F.col("root"))).alias("seed"))
    if params.border_mode == "standard":
        root = F.col("least")
    else:  # a scan in id order: clusters that began earlier take the point, later ones only if it is near their first point
        root = F.when(F.col("least") < F.col("id"), F.col("least")).otherwise(F.col("seed"))
    border = met.select("id", root.alias("root"))
    others = flagged.where(~F.col("is_core")).select("id", "coords", "is_core").join(border, "id", "left")
    rows = rooted.select("id", "coords", F.lit(True).alias("is_core"), "root").unionByName(others)
    numbers = numbered_roots(rooted)
    return rows.join(numbers, "root", "left").select("id", "coords", "is_core", "root", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
