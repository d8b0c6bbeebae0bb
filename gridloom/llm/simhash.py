"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

1. ``fingerprints``: each row's text becomes 64 bits, in one Arrow pass without a shuffle.
2. ``links``: equal fingerprints are one node. A node's bits are cut into ``blocks``
   runs; two nodes that differ in at most ``distance`` bits agree on at least
   ``blocks - distance`` of them, so each node is listed under every choice of that
   many runs and only nodes under the same choice and bits are compared. A list with
   up to ``SMALL`` nodes is joined with itself. A longer one is cut into tiles, each
   pair of tiles is one group of bounded size, and such a group returns a spanning
   forest of its links instead of all of them: components keep each link between
   different fingerprints, and no list, however hot, meets in one task.
3. With ``confirm``, links count only where sketches of the texts' shingles confirm them: the
   more bits may differ, the more unrelated texts are close by chance.
4. Labels of nodes come from star contraction over the links, cut from their lineage
   in the shared checkpoint folder each round.

Rows: a null text counts as empty, an empty text has fingerprint zero, and rows with
that fingerprint are linked like any other. Texts of any length are read whole. Repeated
rows and equal ids stay rows of their own, and the least id names a component whatever
links tie. A null id takes part, but never names a component; a component without any
id has a null name. No rows give no rows. Further columns, of any name, are not read, or
kept as they are by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.llm.common import near, slices
from gridloom.operators.components import components

#: Nodes of a list that is joined with itself; rows of a tile of a longer one; cost of comparing two nodes, in that of
#: listing one (a fiftieth, times the 25 by which lists of real texts are more uneven than those of random bits).
SMALL, TILE, PAIR_COST = 32, 2048, 0.5
#: Shingles of one text that are held as bits at a time; hashes of a sketch.
STRETCH, SKETCH = 8192, 64


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, as unsigned numbers."""
    words = text.encode().lower().split()  # on bytes: A-Z, and the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, 42) for r in runs), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STRETCH):
        octets = hashes[k : k + STRETCH].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", sketched: int | None = None) -> DataFrame:
    """(id, fp long) of every row; ``width`` words to a shingle, repeats included. With ``sketched`` also the ``sketch`` of shingles of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            fps = [fingerprint(shingle_hashes(t, width)) if t else 0 for t in texts]
            columns = [part.column("k"), pa.array(fps, pa.int64())]
            if sketched:
                columns.append(pa.array([sketch(shingle_hashes(t or "", sketched)) for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["k", "fp", "sketch"][: len(columns)])

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, fp long" + ", sketch binary" * bool(sketched)).withColumnRenamed("k", id_col)


def sketch(hashes: np.ndarray) -> bytes:
    """The ``SKETCH`` least distinct hashes."""
    least = np.unique(hashes)[:SKETCH]
    return least.astype(">u8").tobytes()


def resemblance(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two sets of hashes, from their sketches; exact for sets that these hold whole."""
    x, y = np.frombuffer(a, ">u8"), np.frombuffer(b, ">u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)[:SKETCH] if SKETCH in (len(x), len(y)) else np.union1d(x, y)
    return len(np.intersect1d(np.intersect1d(x, y), both)) / len(both)


def confirmed(found: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose texts resemble each other by ``least`` or more.

    ``marked`` has the ``sketch`` of each text; equal fingerprints are one node, and one of its
    texts speaks for all. A link meets the sketches of its ends in joins by fingerprint; a
    sketch is of bounded size.
    """
    ends = cut(found.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    held = cut(marked.join(near(ends), "fp", "left_semi").groupBy("fp").agg(F.min("sketch").alias("sketch")))
    both = found.join(held.select(F.col("fp").alias("a"), F.col("sketch").alias("x")), "a").join(held.select(F.col("fp").alias("b"), F.col("sketch").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [resemblance(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def plan_blocks(nodes: int, distance: int, most: int = 12) -> int:
    """The number of runs that compares and lists fewest nodes, if bits were even. Any choice gives the same links."""

    def work(blocks: int) -> float:
        lists = comb(blocks, distance)
        bits = 64 * (blocks - distance) / blocks
        return lists * (nodes + PAIR_COST * nodes * nodes / 2.0**bits)

    return min(range(distance + 1, most + 1), key=work)


def _keys(blocks: int, distance: int) -> list[int]:
    """Masks of the bits that each choice of runs covers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(runs, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Places (i, j) of a spanning forest of the links among ``fps``."""
    group = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1
        for j in near[np.unique(group[near], return_index=True)[1]].tolist():  # one of each group
            if group[j] != group[i]:
                out.append((i, j))
                group[group == max(group[i], group[j])] = min(group[i], group[j])
    return out


def links(nodes: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints; column ``fp`` of ``nodes`` holds each once.

    Links inside long lists come as spanning forests of bounded tiles.
    """
    blocks = blocks or plan_blocks(nodes.count(), distance)
    masks = _keys(blocks, distance)
    # A list is known by a hash of its choice and bits; should two have one hash, more nodes are compared.
    listed = nodes.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)))).alias("list"))
    sizes = cut(listed.groupBy("list").agg(F.count("*").cast("int").alias("n")).where("n > 1"))
    kept = listed.join(sizes, "list")
    small = kept.where(F.col("n") <= SMALL).select("list", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), "list")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    if sizes.where(F.col("n") > SMALL).isEmpty():
        return pairs.distinct()
    # The tile of a node is a hash of its bits, so that a recomputed task deals alike.
    long = kept.where(F.col("n") > SMALL).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(F.col("tile"), o).alias("lo"), F.greatest(F.col("tile"), o).alias("hi")))
    dealt = long.withColumn("p", F.explode(others)).select("list", "p.lo", "p.hi", "fp")

    def forest(table: pa.Table) -> pa.Table:
        fps = np.sort(table.column("fp").to_numpy())
        found = _forest(fps.view(np.uint64), distance)
        a = np.fromiter((fps[i] for i, _ in found), np.int64, len(found))
        b = np.fromiter((fps[j] for _, j in found), np.int64, len(found))
        return pa.table({"a": a, "b": b})

    tiles = dealt.groupBy("list", "lo", "hi").applyInArrow(forest, "a long, b long")
    return pairs.unionByName(tiles.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(df: DataFrame, width: int = 5, distance: int = 3, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text", confirm: tuple[int, float] | None = None) -> DataFrame:
    """(id, fp, component): one row for each row of the input; the component's name is its least id.

    With ``confirm`` (words, similarity) links between different fingerprints count only if the
    texts' shingles of so many words have that Jaccard similarity, estimated from sketches.
    """
    marked = cut(fingerprints(df, width, id_col, text_col, confirm and confirm[0]))
    nodes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = links(nodes, distance, blocks)
    if confirm:
        found = confirmed(cut(found), marked.select("fp", "sketch"), confirm[1])
        marked = marked.drop("sketch")
    found = components(found)
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    # Each task's least ids come first, so that a large component is a row for each task; cut: AQE can split it in the joins.
    names = cut(named.groupBy("root").agg(F.min("least").alias("component")))
    labels = named.select("fp", "root").join(names, "root").select("fp", "component")
    return marked.join(labels, "fp").select(id_col, "fp", "component")


def hexed(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(df: DataFrame, width: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", confirm: tuple[int, float] | None = None) -> DataFrame:
    """One row of each component, as it is: that of the least id (rows without id come last), and of equal rows any."""
    names = df.columns
    rows = df.toDF(*(f"c{k}" for k in range(len(names))))
    plain = rows.columns
    id_, text = (plain[names.index(c)] for c in (id_col, text_col))
    marks = F.xxhash64(id_, text), F.hash(id_, text)
    key = F.struct(F.col(id_).isNull().alias("without"), F.col(id_).alias("id"), marks[0].alias("a"), marks[1].alias("b"))
    found = cut(near_duplicates(rows.select(key.alias("key"), F.col(text).alias("text")), width, distance, id_col="key", text_col="text", confirm=confirm))
    first = found.select("component.a", "component.b").distinct()
    rows = rows.withColumns({"a1": marks[0], "b1": marks[1]})
    if not found.groupBy("key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["a1", "b1"])
    return rows.join(first, (F.col("a1") == F.col("a")) & (F.col("b1") == F.col("b")), "left_semi").select(*plain).toDF(*names)
