from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import entries
from gridloom.llm import lm_score as lm

SF_DIR = "/root/testdata/sf0.001"
END = lm.END


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def groups(t):
    """Ending and beginning of a token, by the book."""
    return (lm.ENDINGS, lm.BEGINNINGS) if t == END else (int.from_bytes(t[-3:], "big") % lm.ENDINGS, int.from_bytes(t[:2], "big") % lm.BEGINNINGS)


def test_scans_see_the_tokens():
    texts = [b"", b"a bc\td", b"  lead", b"trail ", "é ééé".encode(), b"a"]
    scan = lm.Scan.of(texts)
    want = [t.split() + [END] for t in texts]
    assert np.diff(scan.first).tolist() == [len(w) for w in want]
    flat = [t for w in want for t in w]
    by = {}
    for t, h, *g in zip(flat, scan.hashes.tolist(), scan.ending.tolist(), scan.beginning.tolist()):
        by.setdefault(t, set()).add((h, *g))
        assert tuple(g) == groups(t)
    assert all(len(v) == 1 for v in by.values()) and len({v for s in by.values() for v in s}) == len(by)


def test_features_look_back_inside_a_text_only():
    together = lm.Scan.of([b"x y z", b"a b c d"])
    alone = lm.Scan.of([b"a b c d"])
    for p, q in zip(together.features(), alone.features()):
        assert p[4:].tolist() == q.tolist()


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    texts = [b"word%d " % k * (k % 4) + b"\t" * (k % 3) for k in range(300)] + [b"x" * 500, b" " * 90, b"tail"]
    for text in (b"".join(texts), b"y" * 400, b"a " * 300, b" " * 300):
        whole = lm.Scan.of([text])
        monkeypatch.setattr(lm, "SLICE", 50)
        cut = lm.Scan.of([text])
        monkeypatch.undo()
        for a, b in zip((whole.hashes, whole.ending, whole.beginning, whole.first), (cut.hashes, cut.ending, cut.beginning, cut.first)):
            assert a.tolist() == b.tolist()


def model_of(rng, bits=6, classes=5, subs=3):
    label, sub = np.append(rng.integers(1, classes, lm.ENDINGS), 0), np.append(rng.integers(0, subs, lm.BEGINNINGS), 0)
    top, low = (rng.normal(0, 0.3, (1 << bits, n)).astype(np.float32) for n in (classes, subs))
    return lm.Model(bits, label, sub, top, low, rng.normal(0, 0.5, classes).astype(np.float32), rng.normal(0, 0.5, (classes, subs)).astype(np.float32), np.zeros((classes, subs)))


def test_gradients_are_those_of_differences(monkeypatch):
    monkeypatch.setattr(lm, "UNIT", 1 << 20)
    m = model_of(np.random.default_rng(0))
    scan = lm.Scan.of([b"one two three two one", b"two one"])
    sums = lm.Sums(np.zeros((64, 6)), np.zeros((64, 4)))
    m.factors(scan, sums)
    sums.flush()
    assert sums.top[:, -1].sum() == 4 * len(scan.hashes) and sums.low[:, -1].sum() == 3 * (len(scan.hashes) - 2)
    for weights, g in ((m.top, sums.top[:, :-1]), (m.low, sums.low[:, :-1])):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:6], g.shape)):
            old = weights[at]
            weights[at] = old + 0.01
            up = m.factors(scan).sum()
            weights[at] = old - 0.01
            down = m.factors(scan).sum()
            weights[at] = old
            assert g[at] / lm.UNIT == pytest.approx((up - down) / 0.02 * math.log(10), rel=0.02, abs=1e-3)


def test_factors_do_not_depend_on_the_company(monkeypatch):
    m = model_of(np.random.default_rng(1))
    texts = [f"a few words {k} of text number {k % 7} and {'more ' * (k % 5)}".encode() for k in range(300)]
    whole = m.factors(lm.Scan.of(texts))
    alone = np.concatenate([m.factors(lm.Scan.of([t])) for t in texts])
    assert (whole == alone).all()
    monkeypatch.setattr(lm, "BLOCK", 7)
    assert (m.factors(lm.Scan.of(texts)) == whole).all()


DOCS = [(k, f"The cat number {k % 5} sat on the mat\nand word{k} ran", "x") for k in range(40)]
DOCS += [(100, "", "x"), (101, None, "x"), (102, "y" * 200 + " The\x0bthe  cat", "x"), (103, "a b", "x"), (103, "a b", "x"), (None, "the cat", "x"), (104, "cat " * 40_000, "x")]


@pytest.mark.parametrize("head", [3, 1000])
def test_base_scores(spark, head):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, key string")
    train = df.where("doc_id % 3 != 0")
    model, counts = lm.fit(train, classes=4, bits=8, head=head)
    c = Counter(t for i, text, _ in DOCS if i is not None and i % 3 for t in tokens(text))
    n, v = c.total(), len(c)
    rows = lm.score(df, model, counts).collect()
    want = sorted((i or -1, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 3)) for i, t, _ in DOCS)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want


def by_the_book(model, counts, text):
    """The model's score of a text, token by token in plain Python: explicit sums over features, classes and subclasses."""
    words = tokens(text)
    scan = lm.Scan.of([(text or "").encode().lower()])
    features = scan.features()
    total = 0.0
    for j, t in enumerate(words):
        e, b = groups(t)
        y, s = int(model.classes[e]), int(model.subs[b])
        top = [int(lm._rows(f[j : j + 1], 0, model.bits)[0]) for f in features]
        z = [float(model.bias[k]) + sum(float(model.top[r, k]) for r in top) for k in range(len(model.bias))]
        total += (z[y] - math.log(sum(map(math.exp, z)))) / math.log(10)
        if y:
            low = [int(lm._rows(f[j : j + 1], np.array([y]), model.bits)[0]) for f in features[:3]]
            z = [float(model.low_bias[y, k]) + sum(float(model.low[r, k]) for r in low) for k in range(model.low_bias.shape[1])]
            total += (z[s] - math.log(sum(map(math.exp, z)))) / math.log(10)
        total += math.log10(counts.get(lm.key_of(t), 0) + 1) - float(model.log_size[y, s])
    return total


@pytest.mark.parametrize("head", [3, 1000])
def test_scores_are_those_of_the_book(spark, head):
    df = spark.createDataFrame([d for d in DOCS if d[0] != 104], "doc_id long, text string, key string")
    model, table = lm.fit(df.where("doc_id % 3 != 0"), classes=5, subclasses=3, bits=8, head=head)
    assert np.abs(model.top).max() > 0.1 and np.abs(model.low).max() > 0.1
    counts = {bytes(r["key"]): r["n"] for r in table.collect()}
    texts = {}
    for i, t, _ in DOCS:
        texts.setdefault(i, t)
    for r in lm.score(df, model, table).collect():
        assert r.score == pytest.approx(by_the_book(model, counts, texts[r.doc_id]), abs=1e-3)


def test_probabilities_sum_to_one(spark):
    """Over all seen tokens, and one unseen token for each subclass that there is."""
    train = spark.createDataFrame(DOCS, "doc_id long, text string, key string").where("doc_id < 40")
    model, counts = lm.fit(train, classes=5, subclasses=3, bits=8)
    total = np.zeros(model.log_size.shape)
    for r in counts.collect():
        e, b = groups(bytes(r["key"]))
        total[model.classes[e], model.subs[b]] += (r["n"] + 1) / 10 ** model.log_size[model.classes[e], model.subs[b]]
    total += 1 / 10**model.log_size  # the place for what was never seen
    assert np.allclose(total, 1)
    scan = lm.Scan.of([b"the cat"])
    features = [f[-1:] for f in scan.features()]
    top, low = np.empty((1, 5), np.float32), np.empty((1, 3), np.float32)
    lm._softmax(model.top, [lm._rows(f, 0, model.bits) for f in features], model.bias, np.zeros(1, int), top)
    assert top.sum() == pytest.approx(1, abs=1e-5)
    for y in range(1, 5):
        lm._softmax(model.low, [lm._rows(f, np.array([y]), model.bits) for f in features[:3]], model.low_bias[[y]], np.zeros(1, int), low)
        assert low.sum() == pytest.approx(1, abs=1e-5)


def test_results_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")

    def scored(df):
        model, counts = lm.fit(df.where("doc_id % 7 != 2"), head=500, rounds=3)
        return sorted(tuple(r) for r in lm.score(df, model, counts).collect())

    assert scored(docs.coalesce(1)) == scored(docs.repartition(7, "text"))


def test_rows_grow_with_the_corpus(spark):
    def bits(n):
        return lm.fit(spark.range(1).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {n}), x -> concat('w', x)), ' ') AS text"), rounds=0)[0].bits

    assert bits(100) == 14 < bits(1_000_000) == 15 < bits(2_000_000) == 16


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    rows = entries.op9_lm_score(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_long_tokens_have_short_keys():
    assert lm.key_of(b"a" * 40) == b"a" * 40
    long = lm.key_of(b"a" * 41 + b"xyz")
    assert len(long) == 22 and long[:3] == b"aa" + lm.LONG and long[-3:] == b"xyz"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = lm.fit(none, classes=4, bits=8)
    assert lm.score(none, model, counts).collect() == []
    [row] = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_gradients_are_summed_by_whole_columns(monkeypatch):
    """Sums read each column as it lies in memory, in the kind that they are made in."""
    from gridloom.llm import lm_score as module

    rng = np.random.default_rng(5)
    sums = module.Sums(np.zeros((8, 5), order="F"), np.zeros((8, 5), order="F"))
    row, p, y = rng.integers(0, 8, 50), rng.random((50, 4), dtype=np.float32), rng.integers(0, 4, 50)
    want = np.zeros((8, 4))
    np.add.at(want, row, np.eye(4)[y] * module.UNIT - np.rint(p * np.float32(module.UNIT)))
    plain, read = np.bincount, []
    monkeypatch.setattr(np, "bincount", lambda x, w=None, n=0, minlength=0: (read.append(w), plain(x, w, n or minlength))[1])
    sums.add(([row], p.copy(), y), ([row], p.copy(), y))
    sums.flush()
    assert all(w.dtype == np.float64 and w.flags.c_contiguous for w in read if w is not None)
    assert (sums.top[:, :4] == want).all() and (sums.top[:, 4] == plain(row, minlength=8)).all()
