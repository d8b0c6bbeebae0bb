"""SentencePiece encoding and decoding of whole text columns.

Each task cuts its texts into units, sorts the units that it has not met yet into
a trie and encodes them by the shared-prefix forward pass of :mod:`.spm`. Nothing
is shuffled; memory is bounded by the slice of rows in hand and a unit memory of
fixed size.

Rows: null texts give null ids, empty texts none; texts of any length are encoded whole.
Repeated rows, ids that are null and further columns of the input, of any name, make no
difference; the results have the id column and the columns named here. Of merges that
score alike the leftmost comes first, as in the library. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import spm
from gridloom.llm.common import Memory, held, slices

#: Units remembered by a worker, and the longest one that is.
UNIT_MEMORY, UNIT_CHARS = 60_000, 64


class Encoder:
    """Texts to arrays of ids."""

    def __init__(self, data: bytes) -> None:
        self.model, self.known = held(("encoder", data), lambda: (spm.Model.parse(data), Memory(UNIT_MEMORY, UNIT_CHARS)))
        self.units = re.compile(self.model.unit_pattern()).findall

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.units(self.model.marked(t)) for t in texts]
        known = self.known.of(set().union(*(u for u in cut if u)), self._encode)
        return [None if u is None else np.frombuffer(b"".join(map(known.__getitem__, u)), "<i4") for u in cut]

    def _encode(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        for unit, ids in self.model.segment(sorted(units)):
            yield unit, array("i", ids).tobytes()


class Decoder:
    """Arrays of ids to texts."""

    def __init__(self, model: spm.Model) -> None:
        self.model = m = model
        self.table = [bytes([int(p[1:-1], 16)]) if k == spm.BYTE else b"" if k == spm.CONTROL else p.replace(spm.MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    offsets[1:] = np.cumsum([0 if a is None else len(a) for a in arrays])
    values = np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([a is None for a in arrays]))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    data = spm.read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data)
        for part, texts in slices(batches, "t", keep=True):
            yield pa.RecordBatch.from_arrays([part.column("k"), _lists(encoder.encode(texts))], ["k", "ids"])

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text."""
    data = spm.read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(spm.Model.parse(data))
        for batch in batches:
            column = batch.column("i")
            texts = [decoder.decode(np.asarray(x.values)) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    rows = df.select(F.col(id_col).alias("k"), F.col(ids_col).alias("i"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", id_col)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass.

    (id, n_bytes, n_tokens, ids_sha256 of the ids as 32-bit little-endian numbers,
    text_sha256 of the decoded text, round_trip: whether that equals the text up to
    the word mark's character, which stands for a blank). ``with_ids`` adds the ids.
    A null text counts as empty here.
    """
    data = spm.read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data)
        decoder = Decoder(encoder.model)
        for part, texts in slices(batches, "t", keep=True):
            texts = [t or "" for t in texts]
            ids = encoder.encode(texts)
            back = [decoder.decode(i) for i in ids]
            columns = [
                part.column("k"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                pa.array([b == t.replace(spm.MARK, " ") for b, t in zip(back, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [_lists(ids)] * with_ids, names)

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["k", "n_bytes", "n_tokens", "ids_sha256", "text_sha256", "round_trip"] + ["ids"] * with_ids
    schema = f"k {kind}, n_bytes long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("k", id_col)
