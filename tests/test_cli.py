from __future__ import annotations

from gridloom import cli
from tests.data import BOWS


def test_run(spark, tmp_path):
    source = tmp_path / "points.csv"
    source.write_text("".join(f"{x},{y}\n" for x, y in BOWS))
    cli.main(["--input", str(source), "--output", str(tmp_path / "out"), "--eps", "0.15", "--min-pts", "2", "--format", "csv", "--files", "1", "--debug-dir", str(tmp_path / "steps")])
    assert spark.read.csv(str(tmp_path / "out/labels")).count() == 17
    row = spark.read.option("header", True).csv(str(tmp_path / "out/summary")).first()
    assert (row.total_points, row.num_clusters, row.noise_points) == ("17", "4", "1")
    assert spark.read.parquet(str(tmp_path / "steps/labels")).where("cluster_id > 0").count() == 16
