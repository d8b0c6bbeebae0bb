"""Expressions over coordinate arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column, dims: int) -> Column:
    """Squared Euclidean distance, in double, summed in the order of the dimensions."""
    if dims <= 8:  # written out: one expression of compiled code

        def square(i: int) -> Column:
            d = a[i] - b[i]
            return d * d

        return reduce(lambda s, t: s + t, (square(i) for i in range(dims)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def single(c: Column) -> Column:
    """A number rounded to single precision, as a double."""
    return c.cast("float").cast("double")


def tile(coords: Column, side: float, axes: Sequence[int]) -> Column:
    """The tile of side ``side`` that coordinates fall in, on some of the dimensions."""
    return F.array(*(F.floor(coords[i] / F.lit(side)) for i in axes))


def shifted(cell: Column, offset: tuple[int, ...]) -> Column:
    return F.array(*(cell[i] + F.lit(o) for i, o in enumerate(offset)))
