"""One row about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.metrics import Watch, resources
from gridloom.operators.density import core_points, tiled
from gridloom.operators.grid import copies, grid_of
from gridloom.operators.neighbors import TILED
from gridloom.params import Params
from gridloom.plans.cells import Cells
from gridloom.plans.clustering import density_clusters
from gridloom.sources.points import dimensions


def counts(points: DataFrame, labelled: DataFrame, params: Params) -> DataFrame:
    """Parameters and counts: points, copies near edges, clusters, and points that are core, border and noise."""
    grid = grid_of(points, params)
    ghosts = copies(points, grid).where(~F.col("is_home")).agg(F.count("*").alias("ghost_points")) if grid else points.sparkSession.range(1).select(F.lit(0).cast("long").alias("ghost_points"))
    totals = labelled.agg(
        F.count("*").alias("total_points"),
        F.countDistinct("root").alias("num_clusters"),
        F.count_if("is_core").alias("core_points"),
        F.count_if(~F.col("is_core") & F.col("root").isNotNull()).alias("border_points"),
        F.count_if(F.col("root").isNull()).alias("noise_points"),
    )
    return totals.join(ghosts).select(  # one row each
        F.lit(params.eps).alias("eps"),
        F.lit(int(params.min_pts)).alias("min_pts"),
        F.lit(float(params.cell_factor)).alias("cell_factor"),
        F.lit(float(params.buffer_factor)).alias("buffer_factor"),
        "total_points",
        "ghost_points",
        "num_clusters",
        "core_points",
        "border_points",
        "noise_points",
    )


def run(points: DataFrame, params: Params, run_id: str = "run", dataset: str = "") -> tuple[DataFrame, DataFrame]:
    """(labelled points, summary row): parameters, counts, and what reading and clustering cost.

    ``neighbor_queries`` counts the points that distances were taken for; points of dense
    tiles need none. ``neighbor_seconds`` is the time that tasks spent on the search for
    neighbours, up to the core flags, and ``neighbor_percent`` its share of all tasks' time.
    """
    spark = points.sparkSession
    with Watch(spark) as reading:
        points = cut(points)
    dims = dimensions(points)
    with Watch(spark) as search:
        flagged = None if dims is None else cut(core_points(points, params, dims))
    with Watch(spark) as work:
        labelled = cut(density_clusters(points, params, flagged))
    work.totals.add(search.totals)
    queries = 0
    if dims is not None and dims <= TILED:
        sizes = tiled(points, params, dims).groupBy("tile").agg(F.count("*").alias("n"))
        queries = sizes.where(F.col("n") < params.min_pts).agg(F.sum("n")).first()[0] or 0
    elif dims is not None:
        queries = points.count()
    cost = {k: round(v, 3) if isinstance(v, float) else v for k, v in vars(work.totals).items() if k != "seconds"}
    spent = search.totals.task_seconds
    searched = {"neighbor_seconds": round(spent, 3), "neighbor_percent": round(100 * spent / work.totals.task_seconds, 2) if work.totals.task_seconds else 0.0}
    facts = {"merge": params.merge, "border_mode": params.border_mode, "neighbor_queries": int(queries), "read_seconds": reading.totals.seconds, "cluster_seconds": work.totals.seconds, **searched, **cost, "dataset": dataset, **resources(spark)}
    return labelled, counts(points, labelled, params).select(F.lit(run_id).alias("run_id"), "*", *(F.lit(v).alias(k) for k, v in facts.items()))


def steps(points: DataFrame, params: Params) -> dict[str, DataFrame]:
    """Each step over cells, to be looked at: copies, core flags, local clusters, merge edges, components, labels."""
    cells = Cells(points, params)
    return {"copies": cells.copies, "core_flags": cells.flagged, "local_clusters": cells.local, "merge_edges": cells.same_point_edges(), "components": cells.merged, "labels": cells.point_to_global()}


def dump(points: DataFrame, params: Params, path: str) -> None:
    """Write each step whole below ``path``."""
    for name, step in steps(points, params).items():
        step.write.mode("overwrite").parquet(f"{path}/{name}")


def preview(points: DataFrame, params: Params, rows: int = 10) -> dict[str, list[Row]]:
    """Some rows of each step; which ones is not said."""
    return {name: step.take(rows) for name, step in steps(points, params).items()}
