"""Writers of labelled points and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(labelled: DataFrame) -> DataFrame:
    """(id, line): each labelled point as text: (id, [coordinates], cluster, home, core, cell)."""

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in labelled.columns else F.lit("-")

    coords = F.concat(F.lit("["), F.array_join(F.transform("coords", lambda c: F.call_function("format_number", c, F.lit("0.000000"))), ", "), F.lit("]"))
    home = text("is_home") if "is_home" in labelled.columns else F.lit("true")
    return labelled.select("id", F.concat(F.lit("("), F.concat_ws(", ", F.col("id").cast("string"), coords, text("cluster_id"), home, text("is_core"), text("cell_id")), F.lit(")")).alias("line"))


def write_labels(labelled: DataFrame, path: str, fmt: str = "parquet", files: int | None = None) -> None:
    """Write labels as parquet, csv (arrays as text) or rendered text; ``files`` merges the output into so many."""
    out = labelled
    if fmt == "text":
        out = rendered(labelled).select("line")
    elif fmt == "csv":
        out = labelled.select(*(F.array_join(F.col(n).cast("array<string>"), " ").alias(n) if t.startswith("array") else F.col(n) for n, t in labelled.dtypes))
    elif fmt != "parquet":
        raise ValueError("labels are written as parquet, csv or text")
    if files:
        out = out.coalesce(files)
    getattr(out.write.mode("error"), fmt)(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Append a run's summary row, with a header, to a folder of CSV files."""
    summary.coalesce(1).write.mode("append").option("header", True).csv(path)
