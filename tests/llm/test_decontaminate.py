from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm import decontaminate as de
from gridloom.metrics import Watch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=13):
    w = words(text)
    hit, named = set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for s in range(len(v) - n + 1 if v else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[s : s + n]:
                    hit.update(range(at, at + n))
                    named.update({str(item)} if item is not None else ())
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


def check(spark, docs, items):
    got = de.contamination(spark.createDataFrame(docs, "doc_id long, text string, items string, n_hit string"), spark.createDataFrame(items, "item_id long, text string, phrase int")).collect()
    want = sorted(((i or -1, *brute(t, [x[:2] for x in items])) for i, t, *_ in docs), key=repr)
    assert sorted(((r.doc_id or -1, r.n_words, r.n_hit, r.items, r.contaminated) for r in got), key=repr) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "the", "É", "é", "Ω7", "x1", "Naïve", "naïve", "日本"]

    def text(n):
        return "".join(rng.choice(vocabulary[: rng.choice((2, 9))]) + rng.choice((" ", ", ", "\n", "--")) for _ in range(n))

    items = [(k, text(rng.choice((0, 1, 3, 12, 13, 14, 30))), 0) for k in range(12)] + [(20, "a the " * 10, 0), (21, None, 0), (22, "?!", 0)]
    docs = [(k, text(rng.choice((0, 5, 40, 120))), "", "") for k in range(30)]
    docs += [(100 + k, text(20) + " " + (t or "") + " " + text(3), "", "") for k, t, _ in items]
    check(spark, docs, items)


def test_repeats_nulls_and_long_texts(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = [(1, passage, "", ""), (1, passage, "", ""), (1, "other text", "", ""), (None, passage, "", ""), (None, None, "", ""), (2, "", "", ""), (3, "filler " * 30_000 + passage, "", ""), (4, passage + " filler" * 379, "", ""), (5, passage + " filler" * 381, "", "")]
    check(spark, docs, [(7, passage.upper(), 0), (10, "nothing like it", 0), (None, "other words", 0), (7, passage, 0)])
    check(spark, docs, [(None, passage, 0), (3, "other text", 0), (None, "w3 w4", 0)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in de.contract_rows(docs, none).collect()] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert de.contract_rows(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_shuffled_joins_say_the_same(spark, monkeypatch):
    docs = [(k, f"one two three {k} four five six seven eight nine ten eleven twelve thirteen", "", "") for k in range(20)]
    items = [(1, "seven eight nine", 0), (2, "five", 0), (3, "three 7 four five", 0)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    check(spark, docs, items)
    monkeypatch.setattr(de, "FILTER_BITS", 64)
    check(spark, docs, items)


def test_shuffles_carry_no_texts(spark, monkeypatch):
    """Beyond broadcast, what is shuffled is in proportion to the words, not to their number times the text."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(n)) for n in (4000, 8000)]
    items = spark.createDataFrame([(k, " ".join(texts[1].split()[k * 100 : k * 100 + 20])) for k in range(20)], "item_id long, text string")
    written = []
    for t in texts:
        docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
        with Watch(spark) as w:
            assert de.contamination(docs, items).first().n_words == len(t.split())
        written.append(w.totals.shuffle_write_mb)
    assert max(written) < 2  # the text has 90 KB


def test_clean(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, passage, 1), (2, "fine", 2), (2, "fine", 2), (None, None, 3), (None, passage, 4)], "doc_id long, text string, h long").withColumns({"id": F.lit(1), "__id": F.lit(2), "__h": F.lit(3), "a.b": F.lit(4)})
    rows = de.clean(df, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert sorted(r.h for r in rows) == [2, 2, 3] and set(rows[0].asDict()) == {"doc_id", "text", "h", "id", "__id", "__h", "a.b"}


def test_near_each_other(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("red", "green", "blue", "É", "plain")) for _ in range(60)) for _ in range(6)]
    pairs = [("Red", "blue"), ("é", "É"), ("green", "green"), ("É", "red"), ("none", "red")]
    got = de.near_each_other(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(pairs, "a string, b string"), 4).collect()
    want = []
    for k, t in enumerate(texts):
        w = words(t)
        for a, b in pairs:
            x, y = words(a)[0], words(b)[0]
            want += [(k, a, b, i, j) for i in range(len(w)) for j in range(len(w)) if w[i] == x and w[j] == y and abs(i - j) <= 4 and (x != y or i < j)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_no_python_runs_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = de.contract_rows(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
