"""python -m gridloom.cli --input points.csv --output out [--eps 0.03] [--min-pts 50] ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridloom.params import BORDER_MODES, MERGES, Params
from gridloom.plans.summary import dump, preview, run
from gridloom.sources.points import read_points
from gridloom.sources.sinks import write_labels, write_summary


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Cluster comma-separated points by density.")
    p.add_argument("--input", required=True, help="text file or folder: numbers separated by commas, no header")
    p.add_argument("--output", required=True, help="folder for labels and summary")
    p.add_argument("--eps", type=float, default=0.03, help="radius of a neighbourhood")
    p.add_argument("--min-pts", type=int, default=50, help="neighbours that make a core point, itself included")
    p.add_argument("--cell-factor", type=float, default=3.0)
    p.add_argument("--buffer-factor", type=float, default=1.0)
    p.add_argument("--border-mode", choices=BORDER_MODES, default="standard")
    p.add_argument("--merge", choices=MERGES, default="distributed")
    p.add_argument("--format", choices=("parquet", "csv", "text"), default="parquet")
    p.add_argument("--files", type=int, help="merge the labels into so many files")
    p.add_argument("--run-id", default="run")
    p.add_argument("--debug-dir", help="write the steps over grid cells there, too")
    p.add_argument("--preview", type=int, help="print so many rows of each step over grid cells")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    params = Params(a.eps, a.min_pts, a.cell_factor, a.buffer_factor, a.border_mode, a.merge)
    points = read_points(spark, a.input)
    labelled, summary = run(points, params, a.run_id, a.input)
    write_labels(labelled, f"{a.output}/labels", a.format, a.files)
    write_summary(summary, f"{a.output}/summary")
    if a.debug_dir:
        dump(points, params, a.debug_dir)
    if a.preview:
        for name, rows in preview(points, params, a.preview).items():
            print(name, *rows, sep="\n  ")


if __name__ == "__main__":
    main()
