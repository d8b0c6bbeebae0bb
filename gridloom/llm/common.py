"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import shared_dir

#: Characters of text that an operator holds as Python objects at a time.
SLICE_CHARS = 1_500_000
#: Bytes of text in the rows of a table that may be broadcast.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> bool:
    """Whether the rows of a table that is cheap to read, measured now, have ``BROADCAST_BYTES`` at most."""
    return (df.agg(F.sum(F.octet_length(F.struct(*df.columns).cast("string")))).first()[0] or 0) <= BROADCAST_BYTES


def near(df: DataFrame) -> DataFrame:
    """A table marked for broadcast if it is small."""
    return F.broadcast(df) if small(df) else df


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` returned."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, of one operator at a time (until another one calls :func:`slices`)."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class Memory:
    """What was found out about strings, in two generations of bounded size.

    When the young one is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, size: int, longest: int) -> None:
        self.size, self.longest = size, longest
        self.young: dict = {}
        self.old: dict = {}

    def of(self, wanted: set[str], make: Callable[[list[str]], Iterable[tuple[str, object]]]) -> Mapping[str, object]:
        """A mapping that has all of ``wanted``; ``make`` is asked for what is not remembered."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for x in wanted.difference(young):
            if x in old:
                young[x] = old[x]
            else:
                missing.append(x)
        if not missing:
            return young
        made = dict(make(missing))
        if len(made) + len(young) <= 2 * self.size and max(map(len, missing)) <= self.longest:
            young.update(made)
            return young
        here = {x: young[x] for x in wanted if x in young} | made
        young.update((x, v) for x, v in made.items() if len(x) <= self.longest and len(young) < 2 * self.size)
        return here


def trim() -> None:
    """Give memory that is free back to the machine: workers live longer than tasks, and other processes need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` characters.

    One row is the least; a text is never cut. What another operator holds is dropped, unless
    ``keep`` says that it is the caller's own.
    """
    if not keep:
        _HELD.clear()
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start, total = 0, 0
        for row, n in enumerate(lengths):
            if total and total + n > limit:
                part = batch.slice(start, row - start)
                yield part, part.column(text).to_pylist()
                start, total = row, 0
            total += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, part.column(text).to_pylist()
    trim()
