"""Points: rows of (id, coords)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geometry import single

#: Splits of text files whose first numbers may be broadcast.
BROADCAST_BLOCKS = 100_000

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("coords", T.ArrayType(T.DoubleType(), False), False)])


def points_of(df: DataFrame, id_col: str | Column, coords: str | Sequence[str | Column]) -> DataFrame:
    """(id, coords) of a table: an id, and either an array column or one column for each dimension.

    Rows with a null coordinate have no place and are left out. Ids are expected to be
    distinct; see :func:`numbered` for tables without one.
    """
    if isinstance(coords, str):
        array = F.transform(F.col(coords), lambda c: single(c))
    else:
        array = F.array(*(single(F.col(c) if isinstance(c, str) else c) for c in coords))
    rows = df.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("id"), array.alias("coords"))
    return rows.where(F.col("coords").isNotNull() & ~F.exists("coords", lambda c: c.isNull()))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "id") -> DataFrame:
    """Rows numbered from 0 in an order, without gaps.

    Rows are dealt by range and sorted; each partition numbers its own rows and adds the
    sizes of the partitions in front of it, which are as many numbers as partitions.
    """
    from gridloom.lineage import cut

    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = cut(df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = dict(sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect()))
    before, total = {}, 0
    for part, size in sizes.items():
        before[part], total = total, total + size
    table = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return held.join(F.broadcast(table), "__part").withColumn(name, inside + F.col("__before")).drop("__part", "__at", "__before")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of comma-separated text without a header; ids count the lines that are not blank, in file order.

    The width of the first such line gives the dimensions; a line of another width, or
    with something that is no number, fails the job. An empty input has no points.
    Trailing commas are ignored.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    # A block's lines stand together in one partition, so that they are numbered from its first; nothing is shuffled.
    blocks = sorted(tuple(r) for r in lines.groupBy("file", "block").agg(F.count("*"), F.min("at")).collect())  # as many rows as splits of files
    starts, total = [], 0
    for file, block, n, first in blocks:
        starts.append((file, block, total - first))
        total += n
    table = spark.createDataFrame(starts, "file string, block long, shift long")
    table = F.broadcast(table) if len(starts) <= BROADCAST_BLOCKS else table
    parts = F.split(F.regexp_replace("value", ",+$", ""), ",")
    rows = lines.join(table, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("id"), F.transform(parts, lambda p: single(F.trim(p))).alias("coords"))
    width = dimensions(rows)
    if width is None:
        return spark.createDataFrame([], SCHEMA)
    right = F.when(F.size("coords") == width, F.col("coords")).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} columns in line "), F.col("id").cast("string"))).cast("array<double>"))
    return rows.select(F.col("id").cast("long").alias("id"), right.alias("coords"))


def dimensions(points: DataFrame) -> int | None:
    """The width of the first point; None without any."""
    first = points.select(F.size("coords").alias("n")).first()
    return None if first is None else first["n"]
