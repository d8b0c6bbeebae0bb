"""Registered queries over whole tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import shared_dir
from gridloom.operators import components as graph
from gridloom.operators import density, grid, neighbors
from gridloom.params import Params
from gridloom.plans import summary
from gridloom.plans.cells import Cells, each_alone
from gridloom.plans.clustering import density_clusters
from gridloom.sources.points import numbered, points_of, read_points
from gridloom.sources.sinks import rendered

CUSTOMERS = Params(eps=0.045, min_pts=11)
ORDERS = Params(eps=0.012, min_pts=7)
BASKETS = Params(eps=0.06, min_pts=12)
VECTORS = Params(eps=1.2, min_pts=5)
CENTRE, RADIUS = (0.5, 0.5), 0.1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(_table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_nationkey") / 25, F.col("c_acctbal") / 10000])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return points_of(_table(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_totalprice") / 500000, (days - 8000) / 3000])


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers for each order, of its lines."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    return points_of(lines, "l_orderkey", [F.col("q") / 50, F.col("d") * 5, F.col("t") * 5])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers written as lines of text, in the order of their ids, and read again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    lines = customers(spark, sf_dir).repartitionByRange("id").sortWithinPartitions("id").select(F.array_join(F.col("coords").cast("array<string>"), ",").alias("line"))
    lines.write.text(path)
    return read_points(spark, path).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


def row_number_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "row_id")


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bounds(customers(spark, sf_dir), 2)


def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_of(customers(spark, sf_dir), CUSTOMERS)
    a, b = g.shape
    return spark.createDataFrame([(g.size, g.buffer, a, b, a * b)], "cell_size double, buffer double, cells_0 long, cells_1 long, total_cells long")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = customers(spark, sf_dir)
    return grid.copies(points, grid.grid_of(points, CUSTOMERS))


def home_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = customers(spark, sf_dir)
    rows = grid.home_cells(points, grid.grid_of(points, CUSTOMERS))
    return rows.select("id", F.col("cell")[0].alias("cell_0"), F.col("cell")[1].alias("cell_1"), "cell_id")


def ghost_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).where(~F.col("is_home")).select("id", "cell_id")


def home_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).where("is_home").select("id", "cell_id")


def ghost_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).agg(F.count_if(~F.col("is_home")).alias("ghosts"))


def cell_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).groupBy("cell_id").agg(F.count_if("is_home").alias("homes"), F.count("*").alias("copies"))


def neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_pairs(customers(spark, sf_dir), CUSTOMERS, 2)


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairwise_distance(customers(spark, sf_dir), CUSTOMERS, 2)


def neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_counts(customers(spark, sf_dir), CUSTOMERS, 2)


def neighbor_counts_64d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_counts(vectors(spark, sf_dir), VECTORS, 64)


def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.radius_search(customers(spark, sf_dir), list(CENTRE), RADIUS, 2)


def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.core_points(customers(spark, sf_dir), CUSTOMERS, 2).select("id", "is_core")


def core_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = density.core_points(customers(spark, sf_dir), CUSTOMERS, 2)
    return density.core_components(flagged, CUSTOMERS, 2).select("id", "root")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters(customers(spark, sf_dir), CUSTOMERS, dims=2)


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("id", "is_core", "cluster_id")


def cluster_visit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = Params(CUSTOMERS.eps, CUSTOMERS.min_pts, border_mode="visit_order")
    return density_clusters(customers(spark, sf_dir), params, dims=2).select("id", "cluster_id")


def cluster_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters(orders(spark, sf_dir), ORDERS, dims=2).select("id", "is_core", "cluster_id")


def cluster_baskets_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters(baskets(spark, sf_dir), BASKETS, dims=3).select("id", "is_core", "cluster_id")


def classify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("is_core"), "core").when(F.col("cluster_id") > 0, "border").otherwise("noise")
    return _labels(spark, sf_dir).select("id", kind.alias("kind"))


def clustered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("cluster_id > 0").select("id", "cluster_id")


def noise_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("cluster_id = -1").select("id")


def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("cluster_id > 0").groupBy("root", "cluster_id").agg(F.count("*").alias("points"))


def render_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = customers(spark, sf_dir)
    cells = grid.home_cells(points, grid.grid_of(points, CUSTOMERS)).select("id", "cell_id")
    return rendered(_labels(spark, sf_dir).join(cells, "id"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = customers(spark, sf_dir)
    return summary.counts(points, density_clusters(points, CUSTOMERS), CUSTOMERS)


def _cells(spark: SparkSession, sf_dir: str, merge: str = "auto") -> Cells:
    return Cells(customers(spark, sf_dir), Params(CUSTOMERS.eps, CUSTOMERS.min_pts, merge=merge))


def local_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).local.select("cell_id", "id", "is_home", "is_core", "local_root")


def cells_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell clustered by itself."""
    return each_alone(customers(spark, sf_dir), CUSTOMERS)


def point_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = F.max(F.when(F.col("is_home"), F.col("cell_id")))
    return _cells(spark, sf_dir).copies.groupBy("id").agg(F.count("*").alias("copies"), home.alias("home"), F.bool_or("is_core").alias("is_core"))


def local_cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).keyed().select("key").distinct()


def same_point_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).same_point_edges()


def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge edges in both directions."""
    edges = _cells(spark, sf_dir).same_point_edges()
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "distributed").merged.select("key", F.col("root").alias("component"))


def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same components, from the driver's union-find."""
    return _cells(spark, sf_dir, "driver").merged.select("key", F.col("root").alias("component"))


def point_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).point_to_global()


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of orders and parts, by their least key (parts count down from -1)."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_partkey") - 1).alias("b"))
    found = graph.components(lines)
    return found.groupBy("root").agg(F.count("*").alias("nodes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_points, text_points, row_number_ids, bounds, grid_shape, home_cell, ghost_assignments, home_copies, ghost_count, cell_occupancy,
        neighbor_pairs, pairwise_distance, neighbor_counts, neighbor_counts_64d, radius_search, core_points, core_components,
        cluster_labels, cluster_visit_order, cluster_orders, cluster_baskets_3d, classify_points, clustered_points, noise_points,
        cluster_ids, render_points, run_summary, local_clusters, cells_alone, point_copies, local_cluster_keys, same_point_edges,
        component_edges, connected_components, union_find, point_to_global, graph_components,
    )
}


# --- SQL ---------------------------------------------------------------------------------


def _single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _near(a: str, b: str, dims: int) -> str:
    return " + ".join(f"({a}.c{i} - {b}.c{i}) * ({a}.c{i} - {b}.c{i})" for i in range(dims))


_POINTS = {
    "customer": f"SELECT c_custkey AS id, {_single('c_nationkey / 25e0')} AS c0, {_single('c_acctbal / 10000e0')} AS c1 FROM customer",
    "orders": f"SELECT o_orderkey AS id, {_single('o_totalprice / 500000e0')} AS c0, {_single('''(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 8000) / 3000e0''')} AS c1 FROM orders",
    "baskets": f"SELECT l_orderkey AS id, {_single('min(l_quantity) / 50e0')} AS c0, {_single('min(l_discount) * 5')} AS c1, {_single('min(l_tax) * 5')} AS c2 FROM lineitem GROUP BY l_orderkey",
}


def _steps(points: str, dims: int, p: Params) -> str:
    """Common table expressions: pts, pairs, core, cc (core components), lab (roots), num (numbers)."""
    return f"""WITH RECURSIVE pts AS (SELECT * FROM ({_POINTS[points]})),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON b.c0 BETWEEN a.c0 - {p.eps} * 1.001 AND a.c0 + {p.eps} * 1.001 AND {_near('a', 'b', dims)} <= {p.eps2!r}),
core AS MATERIALIZED (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {p.min_pts}),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN core x ON a = x.id JOIN core y ON b = y.id),
cc(id, root) USING KEY (id) AS (
  SELECT id, id FROM core UNION
  (SELECT links.b, min(cc.root) FROM cc JOIN links ON links.a = cc.id JOIN recurring.cc AS r ON r.id = links.b WHERE cc.root < r.root GROUP BY links.b)),
lab AS (
  SELECT id, root, true AS is_core FROM cc UNION ALL
  SELECT pts.id, min(cc.root), false FROM pts LEFT JOIN pairs ON pairs.a = pts.id LEFT JOIN cc ON cc.id = pairs.b WHERE pts.id NOT IN (SELECT id FROM core) GROUP BY pts.id),
num AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS cluster_id FROM (SELECT DISTINCT root FROM cc)),
labels AS (SELECT id, is_core, lab.root, coalesce(cluster_id, -1) AS cluster_id FROM lab LEFT JOIN num ON num.root = lab.root)"""


_CUSTOMER = _steps("customer", 2, CUSTOMERS)
_SIZE, _BUFFER = repr(CUSTOMERS.cell_size), repr(CUSTOMERS.buffer)
#: Grid over the customers: box, homes, copies.
_GRID = f"""{_CUSTOMER},
box AS (SELECT min(c0) AS l0, max(c0) AS h0, min(c1) AS l1, max(c1) AS h1 FROM pts),
shape AS (SELECT *, CAST(ceil((h0 - l0) / {_SIZE}) AS BIGINT) + 1 AS n0, CAST(ceil((h1 - l1) / {_SIZE}) AS BIGINT) + 1 AS n1 FROM box),
homes AS (
  SELECT id, c0, c1, l0, l1, n0, n1,
    CAST(greatest(0, least(n0 - 1, floor((c0 - l0) / {_SIZE}))) AS INTEGER) AS cell_0,
    CAST(greatest(0, least(n1 - 1, floor((c1 - l1) / {_SIZE}))) AS INTEGER) AS cell_1 FROM pts, shape),
step AS (SELECT unnest([-1, 0, 1]) AS s),
copies AS MATERIALIZED (
  SELECT id, (cell_0 + x.s) * n1 + cell_1 + y.s AS cell_id, x.s = 0 AND y.s = 0 AS is_home FROM homes, step x, step y
  WHERE cell_0 + x.s BETWEEN 0 AND n0 - 1 AND cell_1 + y.s BETWEEN 0 AND n1 - 1
    AND (x.s <> -1 OR c0 - (l0 + cell_0 * {_SIZE}) <= {_BUFFER}) AND (x.s <> 1 OR l0 + cell_0 * {_SIZE} + {_SIZE} - c0 <= {_BUFFER})
    AND (y.s <> -1 OR c1 - (l1 + cell_1 * {_SIZE}) <= {_BUFFER}) AND (y.s <> 1 OR l1 + cell_1 * {_SIZE} + {_SIZE} - c1 <= {_BUFFER}))"""
#: Local clusters in cells, their names, merge edges and components.
_CELLS = f"""{_GRID},
flags AS (SELECT copies.*, core.id IS NOT NULL AS is_core FROM copies LEFT JOIN core ON core.id = copies.id),
llinks AS MATERIALIZED (SELECT x.cell_id, a, b, y.is_core AS b_core FROM pairs JOIN flags x ON x.id = a AND x.is_core JOIN flags y ON y.id = b AND y.cell_id = x.cell_id),
lcc(cell_id, id, root) USING KEY (cell_id, id) AS (
  SELECT cell_id, id, id FROM flags WHERE is_core UNION
  (SELECT l.cell_id, l.b, min(lcc.root) FROM lcc JOIN llinks l ON l.cell_id = lcc.cell_id AND l.a = lcc.id AND l.b_core JOIN recurring.lcc AS r ON r.cell_id = l.cell_id AND r.id = l.b WHERE lcc.root < r.root GROUP BY l.cell_id, l.b)),
local AS MATERIALIZED (
  SELECT f.cell_id, f.id, is_home, is_core, root AS local_root FROM flags f JOIN lcc ON lcc.cell_id = f.cell_id AND lcc.id = f.id WHERE is_core UNION ALL
  SELECT DISTINCT f.cell_id, f.id, is_home, is_core, lcc.root FROM flags f LEFT JOIN llinks l ON l.cell_id = f.cell_id AND l.b = f.id AND NOT l.b_core LEFT JOIN lcc ON lcc.cell_id = l.cell_id AND lcc.id = l.a WHERE NOT is_core),
keyed AS MATERIALIZED (SELECT cell_id || '_' || local_root AS key, id, is_core FROM local WHERE local_root IS NOT NULL),
same AS (SELECT DISTINCT m.a, k.key AS b FROM keyed k JOIN (SELECT id, min(key) AS a FROM keyed WHERE is_core GROUP BY id) m ON m.id = k.id WHERE k.is_core AND k.key <> m.a),
twoway AS MATERIALIZED (SELECT a AS src, b AS dst FROM same UNION SELECT b, a FROM same),
kcc(key, root) USING KEY (key) AS (
  SELECT DISTINCT key, key FROM keyed UNION
  (SELECT e.dst, min(kcc.root) FROM kcc JOIN twoway e ON e.src = kcc.key JOIN recurring.kcc AS r ON r.key = e.dst WHERE kcc.root < r.root GROUP BY e.dst))"""

#: Each cell by itself: neighbours, cores and components among its own copies.
_ALONE = f"""{_GRID},
apairs AS MATERIALIZED (SELECT x.cell_id, a, b FROM pairs JOIN copies x ON x.id = a JOIN copies y ON y.id = b AND y.cell_id = x.cell_id),
acore AS MATERIALIZED (SELECT cell_id, a AS id FROM apairs GROUP BY cell_id, a HAVING count(*) >= {CUSTOMERS.min_pts}),
alinks AS MATERIALIZED (SELECT p.cell_id, a, b FROM apairs p JOIN acore x ON x.cell_id = p.cell_id AND x.id = a JOIN acore y ON y.cell_id = p.cell_id AND y.id = b),
acc(cell_id, id, root) USING KEY (cell_id, id) AS (
  SELECT cell_id, id, id FROM acore UNION
  (SELECT l.cell_id, l.b, min(acc.root) FROM acc JOIN alinks l ON l.cell_id = acc.cell_id AND l.a = acc.id JOIN recurring.acc AS r ON r.cell_id = l.cell_id AND r.id = l.b WHERE acc.root < r.root GROUP BY l.cell_id, l.b))"""

#: A scan in id order, in closed form.
_VISIT = f"""{_CUSTOMER},
met AS (SELECT pairs.a AS id, min(cc.root) AS least, min(CASE WHEN cc.root = cc.id THEN cc.root END) AS seed FROM pairs JOIN cc ON cc.id = pairs.b WHERE pairs.a NOT IN (SELECT id FROM core) GROUP BY pairs.a),
visited AS (SELECT pts.id, coalesce(cc.root, CASE WHEN least < pts.id THEN least ELSE seed END) AS root FROM pts LEFT JOIN cc ON cc.id = pts.id LEFT JOIN met ON met.id = pts.id)"""

ORACLE_SQL: dict[str, str] = {
    "scan_points": f"SELECT id, c0 AS x, c1 AS y FROM ({_POINTS['customer']})",
    "text_points": f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, c0 AS x, c1 AS y FROM ({_POINTS['customer']})",
    "row_number_ids": "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer",
    "bounds": f"{_CUSTOMER} SELECT count(*) AS n, min(c0) AS min_0, max(c0) AS max_0, min(c1) AS min_1, max(c1) AS max_1 FROM pts",
    "grid_shape": f"{_GRID} SELECT {_SIZE}::DOUBLE AS cell_size, {_BUFFER}::DOUBLE AS buffer, n0 AS cells_0, n1 AS cells_1, n0 * n1 AS total_cells FROM shape",
    "home_cell": f"{_GRID} SELECT id, cell_0, cell_1, cell_0 * n1 + cell_1 AS cell_id FROM homes",
    "ghost_assignments": f"{_GRID} SELECT id, cell_id FROM copies WHERE NOT is_home",
    "home_copies": f"{_GRID} SELECT id, cell_id FROM copies WHERE is_home",
    "ghost_count": f"{_GRID} SELECT count(*) FILTER (NOT is_home) AS ghosts FROM copies",
    "cell_occupancy": f"{_GRID} SELECT cell_id, count(*) FILTER (is_home) AS homes, count(*) AS copies FROM copies GROUP BY cell_id",
    "neighbor_pairs": f"{_CUSTOMER} SELECT a, b FROM pairs",
    "pairwise_distance": f"{_CUSTOMER} SELECT a.id AS a, b.id AS b, {_near('a', 'b', 2)} AS d2 FROM pts a JOIN pts b ON a.id < b.id AND {_near('a', 'b', 2)} <= {CUSTOMERS.eps2!r}",
    "neighbor_counts": f"{_CUSTOMER} SELECT a AS id, count(*) AS neighbors FROM pairs GROUP BY a",
    "neighbor_counts_64d": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings)
        SELECT a.id, count(*) AS neighbors FROM v a, v b
        WHERE list_reduce(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x) <= {VECTORS.eps2!r} GROUP BY a.id""",
    "radius_search": f"{_CUSTOMER}, q AS (SELECT {CENTRE[0]}::DOUBLE AS c0, {CENTRE[1]}::DOUBLE AS c1) SELECT pts.id, {_near('pts', 'q', 2)} AS d2 FROM pts, q WHERE {_near('pts', 'q', 2)} <= {RADIUS * RADIUS!r}",
    "core_points": f"{_CUSTOMER} SELECT pts.id, core.id IS NOT NULL AS is_core FROM pts LEFT JOIN core ON core.id = pts.id",
    "core_components": f"{_CUSTOMER} SELECT id, root FROM cc",
    "cluster_labels": f"{_CUSTOMER} SELECT id, is_core, cluster_id FROM labels",
    "cluster_visit_order": f"{_VISIT} SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM visited LEFT JOIN num ON num.root = visited.root",
    "cluster_orders": f"{_steps('orders', 2, ORDERS)} SELECT id, is_core, cluster_id FROM labels",
    "cluster_baskets_3d": f"{_steps('baskets', 3, BASKETS)} SELECT id, is_core, cluster_id FROM labels",
    "classify_points": f"{_CUSTOMER} SELECT id, CASE WHEN is_core THEN 'core' WHEN root IS NOT NULL THEN 'border' ELSE 'noise' END AS kind FROM labels",
    "clustered_points": f"{_CUSTOMER} SELECT id, cluster_id FROM labels WHERE cluster_id > 0",
    "noise_points": f"{_CUSTOMER} SELECT id FROM labels WHERE cluster_id = -1",
    "cluster_ids": f"{_CUSTOMER} SELECT root, cluster_id, count(*) AS points FROM labels WHERE cluster_id > 0 GROUP BY ALL",
    "render_points": f"{_GRID} SELECT labels.id, format('({{}}, [{{:.6f}}, {{:.6f}}], {{}}, true, {{}}, {{}})', labels.id, c0, c1, cluster_id, is_core, cell_0 * n1 + cell_1) AS line FROM labels JOIN homes ON homes.id = labels.id",
    "run_summary": f"""{_GRID} SELECT {CUSTOMERS.eps}::DOUBLE AS eps, {CUSTOMERS.min_pts} AS min_pts, {CUSTOMERS.cell_factor}::DOUBLE AS cell_factor, {CUSTOMERS.buffer_factor}::DOUBLE AS buffer_factor,
        count(*) AS total_points, (SELECT count(*) FROM copies WHERE NOT is_home) AS ghost_points, count(DISTINCT root) AS num_clusters, count(*) FILTER (is_core) AS core_points,
        count(*) FILTER (NOT is_core AND root IS NOT NULL) AS border_points, count(*) FILTER (root IS NULL) AS noise_points FROM labels""",
    "local_clusters": f"{_CELLS} SELECT cell_id, id, is_home, is_core, local_root FROM local",
    "cells_alone": f"""{_ALONE} SELECT c.cell_id, c.id, c.is_home, k.id IS NOT NULL AS is_core, coalesce(k.root, t.root) AS local_root
        FROM copies c LEFT JOIN acc k ON k.cell_id = c.cell_id AND k.id = c.id
        LEFT JOIN (SELECT p.cell_id, p.a AS id, min(acc.root) AS root FROM apairs p JOIN acc ON acc.cell_id = p.cell_id AND acc.id = p.b GROUP BY p.cell_id, p.a) t ON t.cell_id = c.cell_id AND t.id = c.id""",
    "point_copies": f"{_CELLS} SELECT id, count(*) AS copies, max(CASE WHEN is_home THEN cell_id END) AS home, bool_or(is_core) AS is_core FROM flags GROUP BY id",
    "local_cluster_keys": f"{_CELLS} SELECT DISTINCT key FROM keyed",
    "same_point_edges": f"{_CELLS} SELECT a, b FROM same",
    "component_edges": f"{_CELLS} SELECT src, dst FROM twoway",
    "connected_components": f"{_CELLS} SELECT key, root AS component FROM kcc",
    "union_find": f"{_CELLS} SELECT key, root AS component FROM kcc",
    "point_to_global": f"{_CUSTOMER} SELECT id, cluster_id FROM labels",
    "graph_components": """WITH RECURSIVE e AS MATERIALIZED (SELECT l_orderkey AS a, -l_partkey - 1 AS b FROM lineitem UNION SELECT -l_partkey - 1, l_orderkey FROM lineitem),
        cc(id, root) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(cc.root) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS r ON r.id = e.b WHERE cc.root < r.root GROUP BY e.b))
        SELECT root, count(*) AS nodes FROM cc GROUP BY root""",
}
