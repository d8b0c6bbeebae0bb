"""Points that several tests use."""

from __future__ import annotations

import numpy as np

from gridloom.sources.points import SCHEMA

#: Two bows and some strays; the third and fourth point are one radius of 0.15 apart by their decimals.
BOWS = [
    (0.02, 0.31), (0.11, 0.38), (0.21, 0.42), (0.36, 0.42), (0.47, 0.37), (0.56, 0.29), (0.61, 0.18), (0.93, 0.04),
    (0.33, 0.61), (0.41, 0.72), (0.52, 0.78), (0.64, 0.79), (0.76, 0.74), (0.85, 0.66), (0.91, 0.55), (0.08, 0.93), (0.17, 0.96),
]


def frame(spark, points):
    rows = [(k, [float(np.float32(x)) for x in p]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)
