"""Scores of texts under a hashed maximum-entropy language model.

A token is predicted in three factors:

    P(token | history) = P(class | features) * P(subclass | class, features) * P(token | class, subclass)

* Features of the history: the word before, the pair of words before, and the words two
  and three places back (skips). They are hashed into rows of the weights of a softmax
  over classes; the first three, each together with the class, into rows of those over its
  subclasses.
* Classes: endings of words (their last three bytes, hashed) are clustered by the
  endings that follow them in the whole training text. The end of a text is a class
  of its own. Subclasses: beginnings of words (two bytes, hashed), dealt so that all
  weigh alike.
* Within a subclass, a softmax whose weights are the logarithms of the corpus counts plus
  one, with one place for all unseen tokens. It sums to one.

The number of rows grows with the corpus: one for each 32 distinct tokens counted in it,
rounded to a power of two, 2 ** 14 at least and 2 ** ``most_bits`` at most (16 MB for each
factor by default); beyond that, contexts share rows. The counts grow without a bound.

Training is distributed: ``rounds`` slices of the training documents, dealt by a hash
of the id, cover each of them once; in a round each task adds up the gradient of its
documents under the weights of the round, the sums are added by blocks of rows, and
the driver takes one step scaled by each weight's own curvature. Gradients of tokens are
rounded to whole multiples of 1 / ``UNIT`` and added as whole numbers, and so are the
logarithms of counts, so that no result depends on the order or partitioning of rows,
or on which tasks had to run again.

Counts live in a table. The most frequent tokens (``head`` at most) go with the tasks;
occurrences of all other tokens meet their counts in a join by token. A tail token is
rare by definition, so that no key is hot.

Rows: a null or empty text has the end only. Texts of any length are read whole. A
document is known by its id and a hash of its text while its parts are summed; repeated
rows come out as often as they went in. Without training rows all counts are zero; no
rows give no rows. Further columns, of any name, are not read. Tokens of equal count
fall into the head together or not at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.llm.common import slices

#: Keys of what is no word; UTF-8 has none of these bytes.
END, CELL, ROW, LONG = b"\xfe", b"\xfc", b"\xfd", b"\xff"
#: Endings are dealt into so many groups, what follows them into so many, and beginnings into so many.
ENDINGS, FOLLOWERS, BEGINNINGS = 2039, 32, 1021
#: Distinct tokens that a task counts before it hands them on; tokens scored at a time; tokens whose gradients are summed at a time; characters scanned at a time.
FLUSH, BLOCK, HELD, SLICE = 200_000, 8192, 300_000, 400_000
#: Bytes of a token that is its own key; groups of tasks whose gradients are added first.
KEY_BYTES, GROUPS = 40, 1024
#: Whole numbers that stand for a gradient of one, and for a logarithm of one.
UNIT, LOG_UNIT = 1 << 12, 1 << 36

_SOME_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64, for k up to n at least."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = 1 << max(21, n.bit_length())
        out = np.ones(size, np.uint64)
        out[1:] = base
        np.multiply.accumulate(out, out=out)
        _POWERS[base] = out
    return _POWERS[base]


def key_of(token: bytes) -> bytes:
    """The token, or the first bytes, a digest and the last bytes of a very long one."""
    return token if len(token) <= KEY_BYTES else token[:2] + LONG + xxhash.xxh128_digest(token) + token[-3:]


@dataclass
class Scan:
    """The tokens of a run of texts, ends included, without an object for each."""

    hashes: np.ndarray  # uint64, of each token
    ending: np.ndarray  # group of its ending; ENDINGS for an end
    beginning: np.ndarray  # group of its beginning; BEGINNINGS for an end
    first: np.ndarray  # index of each text's first token, and the number of all

    @classmethod
    def of(cls, texts: list[bytes], hashed: bool = True) -> Scan:
        """A long text (which is a slice of its own) is scanned in pieces that end at blanks: bytes need more room than tokens."""
        if len(texts) != 1 or len(texts[0]) <= 2 * SLICE:
            return cls._of(texts, hashed)
        [text], parts, at = texts, [], 0
        while at < len(text):
            blank = _SOME_BLANK.search(text, at + SLICE)
            end = blank.start() if blank else len(text)
            one = cls._of([text[at:end]], hashed)
            cut = len(one.hashes) - (end < len(text))  # the end counts once
            parts.append((one.hashes[:cut], one.ending[:cut], one.beginning[:cut]))
            at = end
        hashes, ending, beginning = map(np.concatenate, zip(*parts))
        return cls(hashes, ending, beginning, np.array([0, len(hashes)]))

    @classmethod
    def _of(cls, texts: list[bytes], hashed: bool) -> Scan:
        data = np.frombuffer(b" ".join([b"", *texts, b""]) if texts else b" ", np.uint8)
        word = ~_BLANK[data]
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        h = np.zeros(len(starts), np.uint64)
        if hashed:
            with np.errstate(over="ignore"):
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data))[: len(data)], out=sums[1:])
                h = (sums[ends] - sums[starts]) * _powers(_P_INVERSE, len(data))[starts]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
        size = ends - starts
        last = data[ends - 1].astype(np.int64)
        last += np.where(size > 1, data[ends - 2].astype(np.int64) << 8, 0)
        last += np.where(size > 2, data[np.maximum(ends - 3, 0)].astype(np.int64) << 16, 0)
        two = data[starts].astype(np.int64)
        two = np.where(size > 1, two << 8 | data[np.minimum(starts + 1, len(data) - 1)], two)
        edge = np.cumsum([1] + [len(t) + 1 for t in texts])  # where each text begins
        words = np.searchsorted(starts, edge)  # words in front of each text
        first = words + np.arange(len(edge))
        place = np.arange(len(starts)) + np.searchsorted(edge, starts, side="right") - 1
        n = int(first[-1])
        hashes, ending, beginning = np.full(n, 1, np.uint64), np.full(n, ENDINGS, np.int64), np.full(n, BEGINNINGS, np.int64)
        hashes[place], ending[place], beginning[place] = h, last % ENDINGS, two % BEGINNINGS
        return cls(hashes, ending, beginning, first)

    def features(self) -> list[np.ndarray]:
        """Numbers of each token's features, before they are mixed."""
        n = len(self.hashes)
        inside = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        back = []
        for k in (1, 2, 3):
            h = np.full(n, 7, np.uint64)
            h[k:] = self.hashes[:-k] if k <= n else 0
            h[inside < k] = 7
            back.append(h)
        a, b, c = back
        with np.errstate(over="ignore"):
            return [a, a * np.uint64(0xD6E8FEB86659FD93) ^ (b >> np.uint64(7)), b + np.uint64(0xE7037ED1A0B428DB), c + np.uint64(0x8EBC6AF09C88C6E3)]


def _rows(feature: np.ndarray, extra: np.ndarray | int, bits: int) -> np.ndarray:
    """The row of weights of a feature, alone or together with a class."""
    with np.errstate(over="ignore"):
        m = (feature ^ np.uint64(extra) if isinstance(extra, int) else feature ^ (extra.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
    return (m >> np.uint64(64 - bits)).astype(np.int64)


def _softmax(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, target: np.ndarray, p: np.ndarray, keep: bool = True) -> np.ndarray:
    """Natural logarithms of the targets' probabilities; with ``keep`` all probabilities go to ``p``.

    Weights are bounded by the steps of training, so that no exponential is too large.
    """
    some = np.empty_like(p)
    np.take(weights, rows[0], axis=0, out=p, mode="clip")
    for r in rows[1:]:
        p += np.take(weights, r, axis=0, out=some, mode="clip")
    p += bias
    mine = p[np.arange(len(target)), target]
    np.exp(p, out=p)
    total = p.sum(axis=1)
    if keep:
        p /= total[:, None]
    return mine - np.log(total)


@dataclass
class Sums:
    """Gradients in whole numbers (floats that hold such), by row: a column for each class or subclass, and how often the row took part. Columns lie together."""

    top: np.ndarray  # (rows, classes + 1)
    low: np.ndarray  # (rows, subclasses + 1)
    held: list[tuple] = field(default_factory=list)
    count: int = 0

    def add(self, *some: tuple[list[np.ndarray], np.ndarray, np.ndarray]) -> None:
        """Rows, probabilities and targets of the tokens of a slice, for both softmaxes; summed when there are many."""
        self.held.append(some)
        self.count += len(some[0][2])
        if self.count >= HELD:
            self.flush()

    def flush(self) -> None:
        for to, parts in zip((self.top, self.low), zip(*self.held)):
            target = np.concatenate([t for _, _, t in parts])
            p = np.concatenate([p for _, p, _ in parts])
            p *= np.float32(-UNIT)
            np.rint(p, out=p)
            p[np.arange(len(target)), target] += UNIT
            p = np.asfortranarray(p, np.float64)  # columns together and as bincount wants them, once for all features
            for rows in zip(*(r for r, _, _ in parts)):  # of one feature
                row = np.concatenate(rows)
                for k in range(p.shape[1]):
                    to[:, k] += np.bincount(row, p[:, k], len(to))
                to[:, -1] += np.bincount(row, minlength=len(to))
        self.held, self.count = [], 0


@dataclass
class Model:
    """Everything scoring needs; of a size set by its parameters."""

    bits: int
    classes: np.ndarray  # of each group of endings, and of the end: 0
    subs: np.ndarray  # of each group of beginnings, and of the end: 0
    top: np.ndarray  # (rows, classes)
    low: np.ndarray  # (rows, subclasses)
    bias: np.ndarray  # (classes,)
    low_bias: np.ndarray  # (classes, subclasses)
    log_size: np.ndarray  # (classes, subclasses): log10 of tokens + distinct tokens + 1
    head: dict[bytes, int] = field(default_factory=dict)
    tokens: int = 0
    distinct: int = 0

    def factors(self, scan: Scan, sums: Sums | None = None) -> np.ndarray:
        """log10 P(class and subclass | history) of each token; adds to the gradients of its natural logarithm."""
        features = scan.features()
        y, sub = self.classes[scan.ending], self.subs[scan.beginning]
        top = [_rows(f, 0, self.bits) for f in features]
        low = [_rows(f, y, self.bits) for f in features[:3]]
        out = np.empty(len(y))
        room = BLOCK if sums is None else len(y)
        p, q = np.empty((room, self.top.shape[1]), np.float32), np.empty((room, self.low.shape[1]), np.float32)
        for at in range(0, len(y), BLOCK):
            part = slice(at, at + BLOCK)
            here = slice(0, len(y[part])) if sums is None else part
            one = _softmax(self.top, [r[part] for r in top], self.bias, y[part], p[here], sums is not None)
            two = _softmax(self.low, [r[part] for r in low], self.low_bias[y[part]], sub[part], q[here], sums is not None)
            two[y[part] == 0] = 0  # the end has no subclasses
            out[part] = (one.astype(np.float64) + two) / math.log(10)
        if sums is not None:
            inner = y > 0
            sums.add((top, p, y), ([r[inner] for r in low], q[inner], sub[inner]))
        return out


def _lowered(texts: list[str | None]) -> list[bytes]:
    return [t.encode().lower() if t else b"" for t in texts]


def corpus_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(key binary, n): how often each token stands in the rows; cells of ending pairs under keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        cells = np.zeros(ENDINGS * FOLLOWERS, np.int64)

        def drain(c: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["key", "n"])

        for _, texts in slices(batches, "t", SLICE):
            data = _lowered(texts)
            for d in data:
                counts.update(d.split())
            counts[END] += len(data)
            scan = Scan.of(data, hashed=False)
            a, b = scan.ending[:-1], scan.ending[1:]
            both = (a < ENDINGS) & (b < ENDINGS)
            cells += np.bincount(a[both] * FOLLOWERS + b[both] % FOLLOWERS, minlength=len(cells))
            if len(counts) > FLUSH:
                yield drain(_keyed(counts))
                counts.clear()
        if counts:
            yield drain(_keyed(counts))
        hit = np.flatnonzero(cells)
        yield drain({CELL + int(k).to_bytes(4, "big"): int(cells[k]) for k in hit})

    return train.select(F.col(text_col).alias("t")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _keyed(counts: Counter) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t, n in counts.items():
        k = key_of(t)
        out[k] = out.get(k, 0) + n
    return out


def cluster(cells: np.ndarray, classes: int, seed: int = 3, passes: int = 25) -> np.ndarray:
    """Ending groups to classes 1..: k-means of the roots of what follows them, by spherical distance, weighted by frequency."""
    mass = cells.sum(axis=1)
    x = np.sqrt(cells / np.maximum(mass, 1)[:, None])
    x -= np.average(x, axis=0, weights=mass) if mass.sum() else 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    frequent = np.argsort(-mass, kind="stable")[: max(classes * 8, 1)]
    centres = x[rng.choice(frequent, classes, replace=False)]
    labels = np.zeros(len(x), np.int64)
    for _ in range(passes):
        labels = (x @ centres.T).argmax(axis=1)
        for k in range(classes):
            mine = labels == k
            if mass[mine].sum():
                centre = (x[mine] * mass[mine][:, None]).sum(axis=0)
                centres[k] = centre / max(np.linalg.norm(centre), 1e-9)
    return labels + 1


def balanced(mass: np.ndarray, parts: int) -> np.ndarray:
    """A part for each group, so that parts weigh alike: heavy groups first, each to the part that is lightest by then."""
    held, out = np.zeros(parts), np.zeros(len(mass), np.int64)
    for g in np.argsort(-mass, kind="stable"):
        out[g] = held.argmin()
        held[out[g]] += mass[g] + 1e-9
    return out


def gradients(train: DataFrame, model: Model, blocks: int, tasks: int, text_col: str) -> Sums:
    """The gradients over all rows, which ``tasks`` tasks read."""
    sent = train.sparkSession.sparkContext.broadcast(model)
    rows, wide, narrow = len(model.top), model.top.shape[1] + 1, model.low.shape[1] + 1
    per = rows // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = Sums(np.zeros((rows, wide), order="F"), np.zeros((rows, narrow), order="F")), False
        for _, texts in slices(batches, "t", SLICE):
            sent.value.factors(Scan.of(_lowered(texts)), sums)
            any_rows = True
        if any_rows:
            sums.flush()
            joint = np.concatenate([sums.top, sums.low], axis=1)
            joint = joint.astype(np.int32 if np.abs(joint).max() < 1 << 31 else np.int64)
            for k in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([joint[k * per : (k + 1) * per].tobytes()], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(s, np.int32 if len(s) == 4 * per * (wide + narrow) else np.int64).astype(np.int64)
                held[k] = held[k] + part if k in held else part
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(v.astype(np.float32) if last else v).tobytes()], pa.binary())], ["block", "sums"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(batches, last=True)

    schema = "block int, sums binary"
    parts = train.select(F.col(text_col).alias("t")).coalesce(tasks).mapInArrow(run, schema)
    # Sums of some tasks first, then of those: no task reads what all tasks have made.
    parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = parts.repartition("block", "group").select("block", "sums").mapInArrow(add, schema)
    parts = parts.repartition(blocks, "block").mapInArrow(finish, schema)
    joint = np.zeros((rows, wide + narrow), np.float32)
    for row in parts.collect():  # as many rows as there are blocks
        joint[row["block"] * per : (row["block"] + 1) * per] = np.frombuffer(row["sums"], np.float32).reshape(per, -1)
    sent.destroy()
    return Sums(joint[:, :wide], joint[:, wide:])


def _step(weights: np.ndarray, sums: np.ndarray, prior: np.ndarray, rate: float, ridge: float) -> None:
    curvature = sums[:, -1:] * np.maximum(prior * (1 - prior), 1e-3)[None, :]
    weights += (rate * np.clip(sums[:, :-1] / UNIT / (curvature + ridge), -4, 4)).astype(np.float32)


def fit(train: DataFrame, classes: int = 16, subclasses: int = 16, bits: int | None = None, most_bits: int = 18, rounds: int = 6, head: int = 200_000, step: float = 0.6, ridge: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table of the counts of all tokens (key, n). Without ``bits`` the number of rows follows from the distinct tokens."""
    counts = cut(corpus_counts(train, text_col))
    first = F.substring("key", 1, 1)
    cells = np.zeros(ENDINGS * FOLLOWERS)
    for row in counts.where(first == F.lit(CELL)).collect():  # ENDINGS * FOLLOWERS at most
        cells[int.from_bytes(row["key"][1:], "big")] = row["n"]
    tokens = counts.where(first != F.lit(CELL))

    def number(part: Column) -> Column:
        return F.conv(F.hex(part), 16, 10).cast("long")

    end = F.col("key") == F.lit(END)
    ending = F.when(end, F.lit(ENDINGS)).otherwise(number(F.substring("key", -3, 3)) % ENDINGS)
    beginning = F.when(end, F.lit(BEGINNINGS)).otherwise(number(F.substring("key", 1, 2)) % BEGINNINGS)
    label, sub = np.zeros(ENDINGS + 1, np.int64), np.zeros(BEGINNINGS + 1, np.int64)
    label[:ENDINGS] = cluster(cells.reshape(ENDINGS, FOLLOWERS), classes - 1)
    weight = np.zeros(BEGINNINGS + 1)
    for row in tokens.groupBy(beginning.alias("g")).agg(F.sum("n").alias("n")).collect():  # a row for each group
        weight[row["g"]] = row["n"]
    sub[:BEGINNINGS] = balanced(weight[:BEGINNINGS], subclasses)
    size, mass = np.zeros((classes, subclasses)), np.zeros((classes, subclasses))
    of = [F.get(F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast("array<int>"), g.cast("int")) for x, g in ((label, ending), (sub, beginning))]
    for row in tokens.groupBy(of[0].alias("y"), of[1].alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # classes * subclasses at most
        size[row["y"], row["s"]] = row["n"] + row["v"]
        mass[row["y"], row["s"]] = row["n"]
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The most frequent tokens by bins of their counts: a sort would bring as many rows of each partition to one task.
    order = F.floor(F.log2("n") * 64)
    room, least = head, None
    for row in sorted(tokens.groupBy(order.alias("bin")).count().collect(), reverse=True):  # 64 bins for each power of two
        room -= row["count"]
        if room < 0:
            break
        least = row["bin"]
    most = tokens.where(order >= (math.inf if least is None else least)).select("key", "n").toArrow()
    known = dict(zip(most.column("key").to_pylist(), most.column("n").to_pylist()))
    bits = bits or min(most_bits, max(14, round(math.log2(totals["v"] + 1)) - 5))
    by_class = mass.sum(axis=1)
    bias = np.log((by_class + 1) / (by_class.sum() + classes)).astype(np.float32)
    low_bias = np.log((mass + 1) / (by_class + subclasses)[:, None]).astype(np.float32)
    model = Model(bits, label, sub, np.zeros((1 << bits, classes), np.float32), np.zeros((1 << bits, subclasses), np.float32), bias, low_bias, np.log10(size + 1), {}, totals["n"], totals["v"])
    low_prior = (mass.sum(axis=0) + 1) / (mass.sum() + subclasses)
    slice_of = F.pmod(F.xxhash64(F.col(id_col), F.lit("round")), F.lit(rounds))
    # A round reads a part of the documents of every partition; so many tasks that each has a whole partition's worth.
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.select(text_col).rdd.getNumPartitions() // max(1, rounds)))
    for k in range(rounds if totals["n"] else 0):
        sums = gradients(train.where(slice_of == k), model, 16, tasks, text_col)
        train.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of the round go when the driver drops its plan
        rate = step / (1 + 0.5 * k)
        _step(model.top, sums.top, np.exp(bias), rate, ridge)
        _step(model.low, sums.low, low_prior, rate, ridge)
    model.head = known
    return model, tokens


def score(df: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = "id {}, h long, key binary, n long, rows long, tokens long, known long, log_count double, log_class double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number = {t: k for k, t in enumerate(m.head)}
        log_count = np.log10(np.append(np.fromiter(m.head.values(), np.float64, len(number)) + 1, 1))
        for part, texts in slices(batches, "t", SLICE):
            data = _lowered(texts)
            scan = Scan.of(data)
            logs = m.factors(scan) - m.log_size[m.classes[scan.ending], m.subs[scan.beginning]]
            ids, hs = part.column("id"), part.column("h").to_pylist()
            # First a row for each text, then one for each of its tail tokens.
            tokens, known, log_n, log_c = [], [], [], []
            keys = [ROW + xxhash.xxh64_digest(b"%d %d" % (h, k)) for k, h in enumerate(hs)]
            ns, owners = [0] * len(data), list(range(len(data)))
            end = number.get(END, -1)
            for k, d in enumerate(data):
                words = d.split()
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                rest = np.flatnonzero(at < 0).tolist()
                tokens.append(len(words) + 1)
                known.append(len(words) - len(rest) + (end >= 0))
                log_n.append(float(log_count[at].sum() + log_count[end]))
                log_c.append(float(logs[scan.first[k] : scan.first[k + 1]].sum()))
                tail = Counter([key_of(words[j]) for j in rest])
                keys += tail
                ns += tail.values()
                owners += repeat(k, len(tail))
            more = len(keys) - len(data)
            take = pa.array(owners, pa.int32())
            columns = [ids.take(take), part.column("h").take(take), pa.array(keys, pa.binary()), pa.array(ns, pa.int64())]
            for values, kind, rest in (([1] * len(data), pa.int64(), 0), (tokens, pa.int64(), 0), (known, pa.int64(), 0), (log_n, pa.float64(), None), (log_c, pa.float64(), None)):
                filler = pa.nulls(more, kind) if rest is None else pa.array(np.zeros(more, np.int64))
                columns.append(pa.concat_arrays([pa.array(values, kind), filler]))
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "key", "n", "rows", "tokens", "known", "log_count", "log_class"])

    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    parts = source.mapInArrow(run, schema.format(source.schema["id"].dataType.simpleString()))
    parts = parts.join(counts.select("key", F.col("n").alias("c")), "key", "left")
    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    # What each of equal rows has once is their greatest value; tail tokens are summed over the rows, in whole numbers.
    rare = F.sum(n * F.round(F.log10(c + 1) * LOG_UNIT).cast("long")) / F.sum("rows") / LOG_UNIT
    sums = parts.groupBy("id", "h").agg(
        F.sum("rows").alias("rows"),
        F.max("tokens").alias("tokens"),
        (F.max("known") + F.sum(F.when(c > 0, n).otherwise(0)) / F.sum("rows")).alias("known"),
        (F.max("log_count") + rare).alias("log_count"),
        F.max("log_class").alias("log_class"),
    )
    each = sums.select("id", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"), "tokens", "known", "log_count", "log_class")
    size = math.log10(model.tokens + model.distinct + 1)
    return each.select(
        F.col("id").alias(id_col),
        F.col("tokens").cast("long").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("log_count") - F.col("tokens") * size).alias("base_score"),
        (F.col("log_count") + F.col("log_class")).alias("score"),
    )


#: Counts and base scores in SQL; the checksum that deals the documents is worked out bit by bit.
ORACLE_BASE = r"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 7 = 2, false) AS held_out
  FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS n FROM t WHERE NOT held_out GROUP BY token),
size AS (SELECT sum(n) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.n) AS n_known, CAST(any_value(size.n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c.n, 0) + 1) / (size.n + size.v + 1))), 5) AS base_score
FROM t LEFT JOIN c USING (token), size GROUP BY doc_id, held_out
"""
