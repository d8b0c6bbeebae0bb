"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is read as its letters (with the marks that belong to them) in lower case, each
run of anything else as one blank, in UTF-8. The network goes over all these bytes,
forwards and backwards, across words, and labels every position with a distribution
over the languages and ``noise``. A text's probabilities are the mean over its
positions.

To be read side by side, a text is cut into pieces of ``STEP`` bytes. A piece is entered
``CONTEXT`` bytes early from either side, so that both states have seen what stands
around it; in front of a text and behind it stand blanks. Where a text is cut depends
on the text alone, so that its results do not depend on what is read beside it (up to
the rounding of sums, which scores are rounded for).

It is trained on the driver, in numpy, by backpropagation through time, on a bounded
sample of whole labelled texts: of each language the ``per_language`` distinct texts with
the least hash among those of up to ``longest`` bytes (fewer of each where there are so
many languages that all would be more than ``most_documents``; more than
``most_languages`` raise an error). Samples are cut into stretches of one to ``STEP``
bytes, so that short texts are learned as well. ``noise`` is learned from made-up words
of random letters and from random letters of all scripts; in training it weighs as much as a language.

A text that is null or has no letter (of a Unicode category L) gets ``und`` and score 0;
else the score is the language's share among languages. A language is any non-null
label of the training rows; without any, every text gets ``und``. Between languages that
score alike the first by name is taken. Texts of any length are read whole. Repeated
rows and null ids make no difference; no rows give no rows; further columns, of any
name, are not read, or kept as they are by :func:`keep`.
"""

from __future__ import annotations

import functools
import math
import random
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices

UNKNOWN = "und"
#: Bytes of a piece, and in front of it and behind it; pieces read side by side; characters handled at a time.
STEP, CONTEXT, LANES, SLICE = 128, 16, 384, 600_000
_BLANK = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


@dataclass
class Bytes:
    """Texts as one run of bytes: where each begins, and the end; whether it has a letter."""

    data: np.ndarray
    edges: np.ndarray
    lettered: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Bytes:
        low = [t.lower() if t else "" for t in texts]
        points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le"), "<u4")
        kind = _kinds()[points]
        ends = np.cumsum([len(t) + 1 for t in low])
        inner = kind > 0
        kept = inner.copy()
        kept[1:] |= inner[:-1]  # the first of other characters behind a letter stays, as a blank
        letters = np.concatenate([[0], np.cumsum(kind == 2)])
        points = np.where(inner, points, _BLANK).astype("<u4")[kept]
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        sizes = np.concatenate([[0], np.cumsum(sizes)])
        number = np.concatenate([[0], np.cumsum(kept)])
        edges = sizes[number[np.concatenate([[0], ends])]]
        lettered = np.diff(letters[np.concatenate([[0], ends])]) > 0
        return cls(np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8), edges, lettered)


@dataclass
class Pieces:
    """Pieces of texts: where each begins, its length, and its text."""

    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, edges: np.ndarray) -> Pieces:
        length = np.diff(edges)
        n = -(-length // STEP)
        owner = np.repeat(np.arange(len(length)), n)
        start = edges[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STEP
        return cls(start, np.minimum(STEP, edges[1:][owner] - start), owner)

    def batches(self, lanes: int = LANES) -> Iterator[np.ndarray]:
        """Numbers of pieces that are read together, alike lengths."""
        order = np.argsort(-self.size, kind="stable")
        for at in range(0, len(order), lanes):
            yield order[at : at + lanes]

    def matrices(self, data: np.ndarray, edges: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, piece) of the bytes read forwards, from ``CONTEXT`` in front on, and backwards, from ``CONTEXT`` behind on."""
        start, size, owner = self.start[some], self.size[some], self.owner[some]
        t = np.arange(CONTEXT + int(size.max()))[:, None]
        low, high = edges[:-1][owner], edges[1:][owner]

        def read(at: np.ndarray) -> np.ndarray:
            inside = (at >= low) & (at < high)
            return np.where(inside, data[np.clip(at, 0, len(data) - 1)], _BLANK)

        return read(start - CONTEXT + t), read(start + size - 1 + CONTEXT - t)


@dataclass
class Direction:
    """One gated recurrent layer: update gate z, reset gate r, candidate n."""

    byte: np.ndarray  # (256, 3H): what a byte adds to the gates, embedding and bias included
    gates: np.ndarray  # (H, 2H)
    inner: np.ndarray  # (H, H)

    def states(self, matrix: np.ndarray) -> np.ndarray:
        """States (time, piece, H), of :meth:`run`, in memory that is made once."""
        size, n = self.inner.shape[0], matrix.shape[1]
        states = np.empty((*matrix.shape, size), np.float32)
        # Gates lie apart, so that all steps go over whole arrays. Sigmoids are 1 / (1 + exp(-x)) and tanh(x) is
        # 1 - 2 / (1 + exp(2 x)), as numpy has a fast exponential; the factors of x are in the weights.
        one, two = np.float32(1), np.float32(2)
        bytes_z, bytes_r, bytes_c = (np.ascontiguousarray(self.byte[:, k * size : (k + 1) * size]) * w for k, w in enumerate((-one, -one, two)))
        gate_z, gate_r = (-np.ascontiguousarray(self.gates[:, k * size : (k + 1) * size]) for k in range(2))
        inner = self.inner * two
        x, zr = np.empty((2, n, size), np.float32), np.empty((2, n, size), np.float32)
        xc, c = np.empty((n, size), np.float32), np.empty((n, size), np.float32)
        z, r = zr
        h = np.zeros((n, size), np.float32)
        with np.errstate(over="ignore"):  # an infinite exponential is a gate that is shut
            for t in range(len(matrix)):
                at = matrix[t].astype(np.intp)
                bytes_z.take(at, 0, x[0], "clip")
                bytes_r.take(at, 0, x[1], "clip")
                bytes_c.take(at, 0, xc, "clip")
                np.matmul(h, gate_z, out=z)
                np.matmul(h, gate_r, out=r)
                zr += x
                np.exp(zr, out=zr)
                zr += one
                np.divide(one, zr, out=zr)
                r *= h
                np.matmul(r, inner, out=c)
                c += xc
                np.exp(c, out=c)
                c += one
                np.divide(-two, c, out=c)
                c += one
                new = states[t]
                np.subtract(h, c, out=new)
                new *= z
                new += c
                h = new
        return states

    def run(self, matrix: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, piece, H), and what training needs of them."""
        size = self.inner.shape[0]
        h = np.zeros((matrix.shape[1], size), np.float32)
        states, tape = np.empty((*matrix.shape, size), np.float32), []
        for t in range(len(matrix)):
            x = self.byte[matrix[t]]
            zr = h @ self.gates
            zr += x[:, : 2 * size]
            _sigmoid(zr)
            z, r = zr[:, :size], zr[:, size:]
            n = (r * h) @ self.inner
            n += x[:, 2 * size :]
            np.tanh(n, out=n)
            if keep:
                tape.append((h, z, r, n))
            h = h - n
            h *= z
            h += n
            states[t] = h
        return states, tape

    def back(self, matrix: np.ndarray, tape: list, d_states: np.ndarray) -> Direction:
        """Gradients, from those of the states."""
        size = self.inner.shape[0]
        gates, inner = np.zeros_like(self.gates), np.zeros_like(self.inner)
        added = np.empty((*matrix.shape, 3 * size), np.float32)
        dh = np.zeros_like(d_states[0])
        for t in range(len(matrix) - 1, -1, -1):
            h, z, r, n = tape[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            d_rh = dn @ self.inner.T
            d_zr = np.concatenate([dh * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            inner += (r * h).T @ dn
            gates += h.T @ d_zr
            added[t, :, : 2 * size], added[t, :, 2 * size :] = d_zr, dn
            dh = dh * z + d_rh * r + d_zr @ self.gates.T
        which, flat = matrix.ravel(), added.reshape(-1, 3 * size)
        byte = np.stack([np.bincount(which, flat[:, k], 256) for k in range(3 * size)], 1).astype(np.float32)
        return Direction(byte, gates, inner)


@dataclass
class Network:
    """Both directions and the labelling layer; the last label is noise."""

    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # (2H + 1, languages + 1)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def make(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        layers = [Direction(make(256, 3 * hidden) * 4, make(hidden, 2 * hidden), make(hidden, hidden)) for _ in range(2)]
        return cls(languages, *layers, make(2 * hidden + 1, len(languages) + 1))

    def label(self, ahead: np.ndarray, behind: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple:
        """Distributions (position, piece, label), zero past a piece's end; with ``keep`` what training needs as well."""
        a, tape_a = self.ahead.run(ahead, keep)
        b, tape_b = self.behind.run(behind, keep)
        position = np.arange(len(ahead) - CONTEXT)[:, None]
        live = position < size
        mirror = np.where(live, CONTEXT + size - 1 - position, 0)
        lanes = np.arange(len(size))
        hidden = a.shape[2]
        a, b = a[CONTEXT:], b[mirror, lanes]
        p = a.reshape(-1, hidden) @ self.out[:hidden]
        p += b.reshape(-1, hidden) @ self.out[hidden:-1]
        p += self.out[-1]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p = p.reshape(*live.shape, -1)
        p *= live[:, :, None]
        return (p, live, mirror, a, b, tape_a, tape_b) if keep else (p,)

    def pooled(self, ahead: np.ndarray, behind: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(piece, label): sums of :meth:`label` over positions; one label after the other lies in memory."""
        hidden = self.ahead.inner.shape[0]
        position = np.arange(len(ahead) - CONTEXT)[:, None]
        live = position < size
        a = self.ahead.states(ahead)[CONTEXT:].reshape(-1, hidden)
        at = np.where(live, CONTEXT + size - 1 - position, 0) * len(size) + np.arange(len(size))
        b = np.take(self.behind.states(behind).reshape(-1, hidden), at.ravel(), axis=0, mode="clip")
        p = self.out[:hidden].T @ a.T
        p += self.out[hidden:-1].T @ b.T
        p += self.out[-1][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= live.ravel() / p.sum(axis=0)
        return p.reshape(-1, *live.shape).sum(axis=1, dtype=np.float64).T

    def gradients(self, ahead: np.ndarray, behind: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of the weighted mean cross-entropy over positions."""
        p, live, mirror, a, b, tape_a, tape_b = self.label(ahead, behind, size, keep=True)
        w = live * weight[None, :].astype(np.float32)
        total = w.sum()
        lanes = np.arange(len(size))
        loss = -(np.log(np.maximum(p[:, lanes, target], 1e-9)) * w).sum() / total
        d = p
        d[:, lanes, target] -= 1
        d *= (w / total)[:, :, None]
        hidden = a.shape[2]
        flat = d.reshape(-1, d.shape[2])
        g_out = np.concatenate([a.reshape(-1, hidden).T @ flat, b.reshape(-1, hidden).T @ flat, flat.sum(axis=0)[None]])
        d_a, d_b = np.zeros((*ahead.shape, hidden), np.float32), np.zeros((*behind.shape, hidden), np.float32)
        d_a[CONTEXT:] = d @ self.out[:hidden].T
        at, lane = np.nonzero(live)
        d_b[mirror[at, lane], lane] = d[at, lane] @ self.out[hidden:-1].T
        ga, gb = self.ahead.back(ahead, tape_a, d_a), self.behind.back(behind, tape_b, d_b)
        return float(loss), [ga.byte, ga.gates, ga.inner, gb.byte, gb.gates, gb.inner, g_out]

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.gates, self.ahead.inner, self.behind.byte, self.behind.gates, self.behind.inner, self.out]

    def probabilities(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Mean over the positions of each text, of all labels; None without a letter."""
        read = Bytes.of(texts)
        pieces = Pieces.of(read.edges)
        sums = np.zeros((len(texts), len(self.languages) + 1))
        for some in pieces.batches():
            ahead, behind = pieces.matrices(read.data, read.edges, some)
            np.add.at(sums, pieces.owner[some], self.pooled(ahead, behind, pieces.size[some]))
        sizes = np.diff(read.edges)
        return [np.round(s / n, 6) if has else None for s, n, has in zip(sums, sizes.tolist(), read.lettered.tolist())]


def noise(rng: random.Random, n: int) -> list[str]:
    """Words of random letters: of the alphabet, and of one stretch of other letters each."""
    letters = [chr(c) for c in np.flatnonzero(_kinds()[: 0x10000] == 2).tolist()]
    out = []
    for k in range(n):
        if k % 2:
            chosen = "abcdefghijklmnopqrstuvwxyz"
        else:
            at = rng.randrange(len(letters) - 64)
            chosen = letters[at : at + 64]
        out.append(" ".join("".join(rng.choice(chosen) for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(2, 20))))
    return out


def _stretches(rng: random.Random, texts: list[str]) -> list[str]:
    """Texts cut into stretches of many lengths."""
    out = []
    for t in texts:
        at = 0
        while at < len(t):
            n = rng.choice((8, 16, 32, 64, STEP, STEP, STEP))
            out.append(t[at : at + n])
            at += n
    return out


def train(samples: dict[str, list[str]], hidden: int = 16, epochs: int = 3, batch: int = 96, rate: float = 0.012, seed: int = 7) -> Network:
    """Fit by Adam, from languages and their texts. All labels weigh alike."""
    languages = sorted(samples)
    network = Network.fresh(languages, hidden, seed)
    if not languages:
        return network
    rng = random.Random(seed)
    texts, target = [], []
    for k, name in enumerate(languages):
        some = _stretches(rng, sorted(samples[name]))
        texts += some
        target += [k] * len(some)
    made = noise(rng, max(64, len(texts) // (2 * len(languages))))
    texts += made
    target += [len(languages)] * len(made)
    read = Bytes.of(texts)
    pieces = Pieces.of(read.edges)
    labels = np.array(target)[pieces.owner]
    share = np.bincount(labels, pieces.size, len(languages) + 1)
    weights = network.weights()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    dice = np.random.default_rng(seed)
    steps = max(1, epochs * -(-len(labels) // batch))
    for _ in range(epochs):
        order = dice.permutation(len(labels))
        stretch = 16 * batch  # inside it, alike lengths together
        order = np.concatenate([o[np.argsort(-pieces.size[o], kind="stable")] for o in (order[k : k + stretch] for k in range(0, len(order), stretch))]) if len(order) else order
        for at in dice.permutation(np.arange(0, len(order), batch)):
            some = order[at : at + batch]
            ahead, behind = pieces.matrices(read.data, read.edges, some)
            y = labels[some]
            _, grads = network.gradients(ahead, behind, pieces.size[some], y, share.mean() / np.maximum(share[y], 1))
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for w, g, a, b in zip(weights, grads, first, second):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return network


def sample(labelled: DataFrame, per_language: int, longest: int, most_documents: int, most_languages: int, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The texts to learn from, by language.

    Distinct texts are counted by language (approximately), so that a bound on the hash
    leaves somewhat more than are wanted; the least of these are taken on the driver.
    """
    u = F.pmod(F.xxhash64(text_col), F.lit(1 << 40))
    rows = labelled.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), u.alias("u"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.octet_length("t") <= longest))
    counts = rows.groupBy("l").agg(F.approx_count_distinct("u", 0.02).alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    per = max(1, min(per_language, most_documents // len(counts)))
    some = per + 6 * math.sqrt(per) + 6
    bounds = [(r["l"], int(min(1.0, 1.15 * some / r["n"]) * (1 << 40))) for r in counts]
    limits = labelled.sparkSession.createDataFrame(bounds, "l string, bound long")
    found = rows.join(F.broadcast(limits), "l").where("u < bound").select("l", "u", "t").dropDuplicates(["l", "u"]).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["l"], r["u"])):
        if len(out.setdefault(r["l"], [])) < per:
            out[r["l"]].append(r["t"])
    return out


def fit(labelled: DataFrame, per_language: int = 120, longest: int = 16_384, most_documents: int = 4_000, most_languages: int = 2_000, hidden: int = 16, epochs: int = 3, text_col: str = "text", lang_col: str = "lang") -> Network:
    """Train on rows of (text, language), of which a bounded sample is taken."""
    return train(sample(labelled, per_language, longest, most_documents, most_languages, text_col, lang_col), hidden, epochs)


def predict(df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The network has a fixed size and goes with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t", SLICE):
            found = network.probabilities(texts) if network.languages else [None] * len(texts)
            names = [UNKNOWN if p is None else network.languages[int(p[:-1].argmax())] for p in found]
            scores = [0.0 if p is None else min(1.0, round(float(p[:-1].max() / max(p[:-1].sum(), 1e-9)), 5)) for p in found]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", id_col)


def keep(df: DataFrame, network: Network, most_noise: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, as they are, that have a letter and whose positions are noise with a mean probability of ``most_noise`` at most."""
    names = df.columns
    plain = [f"c{k}" for k in range(len(names))]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, plain[at], SLICE):
            found = network.probabilities(texts) if network.languages else [None] * len(texts)
            yield part.filter(pa.array([p is not None and p[-1] <= most_noise for p in found], pa.bool_()))

    rows = df.toDF(*plain)
    return rows.mapInArrow(run, rows.schema).toDF(*names)
