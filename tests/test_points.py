from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import points_of, read_points
from gridloom.sources.points import numbered
from gridloom.sources.sinks import rendered, write_labels


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lines_are_numbered_without_blank_ones(spark, tmp_path):
    rows = read_points(spark, write(tmp_path / "p.csv", "\n0.1,0.2\n   \n0.15, 0.15\n4,5,\n\n")).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1, 2]
    assert rows[0].coords == [float(np.float32(0.1)), float(np.float32(0.2))]
    assert rows[2].coords == [4.0, 5.0]


def test_three_dimensions(spark, tmp_path):
    rows = read_points(spark, write(tmp_path / "p.csv", ".1,.1,.1\n.15,.15,.15\n.2,.2,.2\n")).collect()
    assert {len(r.coords) for r in rows} == {3}


def test_many_files_keep_their_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("".join(f"{k}.0,{j}.0\n" for j in range(40)))
    rows = read_points(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r.coords) for r in rows] == [(float(k), float(j)) for k in range(3) for j in range(40)]


def test_files_of_many_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "p.csv").write_text("".join(f"{j},1\n" + "\n" * (j % 3) for j in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert [int(r.coords[0]) for r in read_points(spark, str(tmp_path)).orderBy("id").collect()] == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["1,2\n3\n", "1,2\n3,x\n"])
def test_bad_lines_fail(spark, tmp_path, text):
    with pytest.raises(Exception):
        read_points(spark, write(tmp_path / "p.csv", text)).collect()


def test_an_empty_file_has_no_points(spark, tmp_path):
    assert read_points(spark, write(tmp_path / "p.csv", "\n \n")).collect() == []


def test_tables_lose_rows_without_a_place(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, "x"), (2, None, 1.0, "y")], "k long, x double, y double, coords string")
    assert [(r.id, r.coords) for r in points_of(df, "k", ["x", "y"]).collect()] == [(1, [0.5, 1.0])]


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert sorted((r.v, r.n) for r in numbered(df, ["v"], "n").collect()) == [(k, k) for k in range(1000)]
    assert numbered(spark.createDataFrame([], "v long"), ["v"], "n").collect() == []


def test_labels_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.25], 3, True)], "id long, coords array<double>, cluster_id int, is_core boolean")
    assert rendered(df).first().line == "(1, [0.500000, 0.250000], 3, true, true, -)"
    for fmt in ("parquet", "csv", "text"):
        write_labels(df, str(tmp_path / fmt), fmt, files=1)
    assert spark.read.text(str(tmp_path / "text")).count() == 1
    with pytest.raises(ValueError):
        write_labels(df, str(tmp_path / "x"), "orc")
