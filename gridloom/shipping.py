"""The package on the workers: executors that do not have it get it from the driver."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to all executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(), "gridloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, Path(here.name) / source.relative_to(here))
    context.addPyFile(path)
    _SENT.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
