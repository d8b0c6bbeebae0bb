"""Media columns: payloads kept as progressive JPEG files, and files as RGB tensors.

A payload's bytes, less 128, are the quantised coefficients of a 4:2:0 image, plane
after plane. Coefficients are what the format keeps without loss (samples pass through
a rounded transform), so they are the unit that holds the payload; its length stands in
a comment. Reading accumulates the scans into coefficient arrays, from which both the
payload and the picture come: inverse transform, upsampled chroma, full-resolution RGB.

Every function works row by row in Arrow batches; nothing is shuffled. Memory is
bounded by a slice of rows, or by one row where that is larger.

Rows: a null payload or file gives null results, where nothing else is said; a file that
is broken, sequential or too large gives nulls and a reason. Empty texts are payloads like
others, and texts of any length are stored whole. Equal texts give equal values. Repeated
rows, null ids and further columns of any name make no difference; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import jpeg
from gridloom.llm.common import slices

#: Bytes that a unit of 4:2:0 holds, and bytes of payload that are coded together.
UNIT_BYTES, SLICE_BYTES = 6 * 64, 600_000
_COMMENT = b"payload "


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file of each payload."""
    units = [max(1, -(-len(p) // UNIT_BYTES)) for p in payloads]
    width = np.array([math.isqrt(u - 1) + 1 for u in units])
    height = -(-np.array(units) // width)
    shape = jpeg.Shape(width, height)
    c = np.zeros((shape.blocks, 64), np.int16)
    for k, p in enumerate(payloads):
        values = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        at = 0
        for first in shape.first:
            plane = c[first[k] : first[k + 1]].reshape(-1)
            some = values[at : at + len(plane)]
            plane[: len(some)] = some
            at += len(some)
    return jpeg.write(c, shape, [_COMMENT + str(len(p)).encode() for p in payloads])


def decode(files: list[bytes], colours: bool = True) -> list[tuple[bytes, np.ndarray | None]]:
    """(payload, RGB tensor) of each file that :func:`encode` wrote; tensors only with ``colours``."""
    out: list = [None] * len(files)
    groups, failed = jpeg.read(files)
    if failed:
        raise ValueError(f"no files of payloads: {failed}")
    for members, shape, c, heads in groups:
        units = jpeg.rgb_units(c, shape, heads) if colours else None
        for k, place in enumerate(members):
            rgb = jpeg.image(units[shape.units[k] : shape.units[k + 1]], int(shape.width[k]), int(shape.height[k])) if colours else None
            out[place] = (_payload(c, shape, k, heads[k]), rgb)
    return out


def _payload(c: np.ndarray, shape: jpeg.Shape, k: int, head: jpeg.Parsed) -> bytes:
    if not head.comment.startswith(_COMMENT):
        raise ValueError("the file holds no payload")
    data = np.concatenate([c[first[k] : first[k + 1]].reshape(-1) for first in shape.first])
    return (data[: int(head.comment[len(_COMMENT) :])] + 128).astype(np.uint8).tobytes()


def to_media(df: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """(id, media binary) of every row's binary payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, payloads in slices(batches, "p", SLICE_BYTES):
            given = [k for k, p in enumerate(payloads) if p is not None]
            files: list = [None] * len(payloads)
            for k, f in zip(given, encode([payloads[k] for k in given]) if given else []):
                files[k] = f
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(files, pa.binary())], ["k", "media"])

    rows = df.select(F.col(id_col).alias("k"), F.col(payload_col).alias("p"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, media binary").withColumnRenamed("k", id_col)


def from_media(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, height, width, rgb binary, error) of every row's progressive file: samples row by row, three to a pixel.

    A file that cannot be read has nulls, and says why in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files in slices(batches, "m", SLICE_BYTES):
            given = [k for k, f in enumerate(files) if f is not None]
            found: list = [(None, None, None, None)] * len(files)
            groups, failed = jpeg.read([files[k] for k in given])
            for place, why in failed.items():
                found[given[place]] = (None, None, None, why)
            for members, shape, c, heads in groups:
                units = jpeg.rgb_units(c, shape, heads)
                for k, place in enumerate(members):
                    rgb = jpeg.image(units[shape.units[k] : shape.units[k + 1]], int(shape.width[k]), int(shape.height[k]), heads[k].size)
                    found[given[place]] = (rgb.shape[0], rgb.shape[1], rgb.tobytes(), None)
            columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary(), pa.string()))] if found else []
            yield pa.RecordBatch.from_arrays([part.column("k"), *columns], ["k", "height", "width", "rgb", "error"])

    rows = df.select(F.col(id_col).alias("k"), F.col(media_col).alias("m"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, height int, width int, rgb binary, error string").withColumnRenamed("k", id_col)


def text_media(df: DataFrame, multiple: int = 576, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media and back: one row for each of the input's.

    A text's UTF-8 (null: empty) is filled up with bytes 255 to a positive multiple of
    ``multiple``, written as a file, and read back from that. Columns: id, n_bytes
    (unfilled), payload_bytes, payload_sha256 and tail_crc32 (the last 32 bytes) as read
    back, media_bytes, media_sha256, feature: height x width and the mean of each colour
    over all pixels, and of the tensor of full resolution height, width and rgb_sha256.
    """
    names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t", SLICE_BYTES):
            data = [(t or "").encode() for t in texts]
            files = encode([d + b"\xff" * (-len(d) % multiple if d else multiple) for d in data])
            back: list = [None] * len(files)
            feature, size, digest = [""] * len(files), [(0, 0)] * len(files), [""] * len(files)
            groups, failed = jpeg.read(files)
            if failed:
                raise ValueError(f"files that were just written cannot be read: {failed}")
            for members, shape, c, heads in groups:
                units = jpeg.rgb_units(c, shape, heads)
                sums = np.add.reduceat(units.reshape(shape.units[-1], -1, 3).sum(axis=1, dtype=np.int64), shape.units[:-1], axis=0)
                for k, place in enumerate(members):
                    back[place] = _payload(c, shape, k, heads[k])
                    h, w = size[place] = heads[k].size
                    digest[place] = hashlib.sha256(jpeg.image(units[shape.units[k] : shape.units[k + 1]], int(shape.width[k]), int(shape.height[k])).tobytes()).hexdigest()
                    feature[place] = f"{h}x{w}:" + ",".join(f"{x / (h * w):.3f}" for x in sums[k].tolist())
            columns = [
                [len(d) for d in data],
                [len(p) for p in back],
                [hashlib.sha256(p).hexdigest() for p in back],
                [zlib.crc32(p[-32:]) for p in back],
                [len(f) for f in files],
                [hashlib.sha256(f).hexdigest() for f in files],
                feature,
                [h for h, _ in size],
                [w for _, w in size],
                digest,
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("k"), *map(pa.array, columns, kinds)], names)

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", id_col)
