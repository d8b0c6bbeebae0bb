from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import entries
from gridloom.llm import language_id as li

SF_DIR = "/root/testdata/sf0.01"


def ready(texts):
    read = li.Bytes.of(texts)
    pieces = li.Pieces.of(read.edges)
    some = np.arange(len(pieces.size))
    return (*pieces.matrices(read.data, read.edges, some), pieces.size)


def fresh(languages="abc", hidden=4, scale=0.5):
    net = li.Network.fresh(list(languages), hidden)
    for w in net.weights():
        w *= scale
    return net


def test_gradients_are_those_of_differences():
    net = fresh()
    given = (*ready(["abc", "hello", "zz"]), np.array([0, 1, 3]), np.array([1.0, 2.0, 0.5]))
    _, grads = net.gradients(*given)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = net.gradients(*given)[0]
        w[at] = old - step
        down = net.gradients(*given)[0]
        w[at] = old
        assert g[at] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=1e-4)


def by_the_book(net, text):
    """The mean over positions, with one byte and one number at a time."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    data = (" ".join(letters.split()) + " ").encode()

    def states(layer, read):
        size = layer.inner.shape[0]
        h, out = [0.0] * size, []
        for byte in read:
            x = layer.byte[byte].tolist()
            gate = [1 / (1 + math.exp(-(x[k] + sum(h[j] * float(layer.gates[j, k]) for j in range(size))))) for k in range(2 * size)]
            z, r = gate[:size], gate[size:]
            n = [math.tanh(x[2 * size + k] + sum(r[j] * h[j] * float(layer.inner[j, k]) for j in range(size))) for k in range(size)]
            h = [(1 - z[k]) * n[k] + z[k] * h[k] for k in range(size)]
            out.append(h)
        return out

    pad = b" " * li.CONTEXT
    full, total = pad + data + pad, [0.0] * net.out.shape[1]
    for at in range(0, len(data), li.STEP):
        size = min(li.STEP, len(data) - at)
        window = full[at : at + size + 2 * li.CONTEXT]
        a = states(net.ahead, window[: li.CONTEXT + size])[li.CONTEXT :]
        b = states(net.behind, reversed(window[li.CONTEXT :]))[li.CONTEXT :][::-1]
        for f, g in zip(a, b):
            z = [sum(v * float(w) for v, w in zip([*f, *g, 1.0], net.out[:, k])) for k in range(len(total))]
            e = [math.exp(v) for v in z]
            total = [t + v / sum(e) for t, v in zip(total, e)]
    return [t / len(data) for t in total]


def test_probabilities_are_those_of_the_book():
    net = fresh(hidden=3, scale=0.8)
    texts = ["xyz", "Über 12 die, Brücke!", "a", "one two three " * 20, "日本語 x", "é"]
    for t, p in zip(texts, net.probabilities(texts)):
        assert np.allclose(p, by_the_book(net, t), atol=2e-5)


def test_what_is_read_beside_a_text_changes_nothing(monkeypatch):
    net = fresh(hidden=8)
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcdeé 日,") for _ in range(rng.choice((1, 5, 40, 200, 1000)))) for _ in range(60)]
    together = net.probabilities(texts)
    monkeypatch.setattr(li, "LANES", 7)
    for t, p in zip(texts, together):
        [q] = net.probabilities([t])
        assert (p is None and q is None) or np.allclose(p, q, atol=2e-6)


def test_words_are_read_in_their_company():
    """The states pass from word to word: neighbours change a word's labels, and an early byte those of a later word."""
    net = fresh(hidden=6, scale=1.0)
    a, b, size = ready(["xyz the"])
    c, d, _ = ready(["xyq the"])
    (p,), (q,) = net.label(a, b, size), net.label(c, d, size)
    assert not np.allclose(p[0, 0], q[0, 0]) and not np.allclose(p[5, 0], q[5, 0])


def test_what_is_a_letter():
    read = li.Bytes.of(["½ ² ①", "", None, "5!", "ét", "́", "ß", "x1y  Z", "한국"])
    assert read.lettered.tolist() == [False, False, False, False, True, False, True, True, True]
    assert bytes(read.data[read.edges[7] : read.edges[8]]) == b"x y z " and read.edges[3] == 0


@pytest.fixture(scope="module")
def scored(spark):
    return entries.op8_language_id(spark, SF_DIR).collect()


def test_held_out_documents(spark, scored):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(scored) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [r.lang_pred == lang[r.doc_id] for r in scored if r.held_out]
    assert sum(held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)


def test_noise_goes_and_documents_stay(spark):
    """On real rows: at most one in five hundred goes; of planted noise and untaught scripts nearly all does."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    net = li.fit(docs)
    n = docs.where("text is not null and text rlike '[a-zA-Z]'").count()
    assert li.keep(docs, net).count() >= n * 0.998
    rng = random.Random(99)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(20)) for _ in range(50)]
    junk += ["Привет, как дела сегодня " * 3, "日本語のテキスト", "Καλημέρα κόσμε", "שלום עולם"]
    assert li.keep(spark.createDataFrame([(t,) for t in junk], "text string"), net).count() <= 2


def small():
    return li.train({"en": ["the and thing the and the " * 4] * 3, "de": ["und über der und der über " * 4] * 3}, hidden=8, epochs=30, batch=8)


def test_rows(spark):
    net = small()
    rows = [(1, "the and the", "x"), (1, "the and the", "x"), (None, "der und über", "x"), (2, None, "x"), (3, "", "x"), (4, "123 ?!", "x"), (5, "THE AND " * 20_000, "x")]
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0.5) for r in li.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), net).collect())
    assert got == [(0, "de", True), (1, "en", True), (1, "en", True), (2, "und", False), (3, "und", False), (4, "und", False), (5, "en", True)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score string, c0 int, `a.b` int")
    kept = li.keep(df, net, most_noise=1.0)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 5]


def test_samples_are_bounded_and_hold_distinct_texts(spark):
    rows = [("en", f"text number {k % 300}") for k in range(3000)] + [("en", "copied " * 3)] * 2000 + [("de", f"wort {k}") for k in range(7)] + [("de", "lang " * 9000), (None, "x"), ("fr", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = li.sample(df, 20, 1000, 4000, 10)
    assert {k: len(set(v)) for k, v in got.items()} == {k: len(v) for k, v in got.items()} == {"en": 20, "de": 7}
    assert got == li.sample(df.coalesce(1), 20, 1000, 4000, 10)
    assert {k: len(v) for k, v in li.sample(df, 20, 1000, 8, 10).items()} == {"en": 4, "de": 4}
    with pytest.raises(ValueError):
        li.sample(df, 20, 1000, 4000, 1)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    net = li.fit(docs)
    assert [r.lang_pred for r in li.predict(docs, net).collect()] == ["und", "und"]
    assert li.keep(docs, net).collect() == []
    assert li.predict(docs.limit(0), net).collect() == []


def test_states_are_those_of_training():
    """The way without memory of its steps has the same states, and asks for no slow hyperbolic tangent."""
    network = li.Network.fresh(["a", "b"], 16)
    matrix = np.random.default_rng(2).integers(0, 256, (40, 30)).astype(np.uint8)
    network.ahead.byte[:, :5] *= 100  # gates that are shut
    want = network.ahead.run(matrix)[0]
    tanh, np.tanh = np.tanh, None
    try:
        got = network.ahead.states(matrix)
    finally:
        np.tanh = tanh
    assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-5
