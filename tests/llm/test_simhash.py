from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(fps, distance):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def nodes(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")


def test_shingles_are_hashed_like_the_engines(spark):
    df = spark.createDataFrame([("a b c",), ("é Ω x",)], "t string")
    assert [r.h % (1 << 64) for r in df.select(F.xxhash64("t").alias("h")).collect()] == [int(simhash.shingle_hashes(t, 3)[0]) for t in ("a b c", "é Ω x")]


@pytest.mark.parametrize("text", ["", " \t\n", "one", "a b", "A b C", "a b c d", "x " * 9000, "É é z w\x0b\x0cq", "the cat sat on the mat " * 40])
def test_fingerprints(text):
    for width in (1, 3, 5):
        assert simhash.fingerprint(simhash.shingle_hashes(text, width)) % (1 << 64) == brute_fingerprint(text, width)


def chained(rng, n, bits):
    out = [rng.getrandbits(64)]
    while len(out) < n:
        f = rng.choice(out)
        for b in rng.sample(range(64), bits):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize(("distance", "blocks"), [(3, None), (3, 4), (3, 6), (1, 3), (0, 2), (5, 7)])
def test_links_connect_what_is_close(spark, distance, blocks, monkeypatch):
    rng = random.Random(distance)
    fps = sorted(set(chained(rng, 60, 1) + chained(rng, 60, 3) + chained(rng, 40, 4) + [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]))
    want = brute_components(fps, distance)
    for small, tile in ((64, 2048), (2, 10)):  # joined lists, and tiles
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "TILE", tile)
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes(spark, fps), distance, blocks).collect()]
        assert all(a != b and bin(a ^ b).count("1") <= distance for a, b in links)
        at = {f: k for k, f in enumerate(fps)}
        root = list(range(len(fps)))
        for a, b in links:
            x, y = root[at[a]], root[at[b]]
            root = [min(x, y) if r in (x, y) else r for r in root]
        assert root == want


def test_forests_span():
    rng = random.Random(3)
    fps = np.array(sorted(set(chained(rng, 150, 2))), np.uint64)
    found = simhash._forest(fps, 3)
    want = brute_components([int(f) for f in fps], 3)
    assert len(found) == len(fps) - len(set(want))


ROWS = [(5, "the quick brown fox jumps over the lazy dog", "x"), (3, "The quick brown fox jumps over the lazy dog", "x"), (3, "The quick brown fox jumps over the lazy dog", "x"), (8, "something else entirely is written in this place", "x"), (None, "something else entirely is written in this place", "x"), (9, "", "x"), (7, None, "x"), (None, "only a row without an id has this text", "x")]


def test_classes(spark):
    rows = simhash.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string, fp string"), width=3).collect()
    got = sorted(((r.doc_id or -1, r.component or -1) for r in rows))
    assert got == [(-1, -1), (-1, 8), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 7)]


def test_one_of_each_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp string")
    kept = simhash.keep_one(df, width=3)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    clashing = df.withColumns({c: F.lit(1) for c in ("__a", "__b", "a", "b", "key", "c0", "component", "x.y")})
    kept = simhash.keep_one(clashing, width=3)
    assert kept.columns == clashing.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.near_duplicates(docs, width=3).select("doc_id", simhash.hexed().alias("f"), "component").collect()
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [brute_fingerprint(t, 3) for _, t in texts]
    root = brute_components(fps, 3)
    want = [(texts[k][0], f"{fps[k]:016x}", texts[root[k]][0]) for k in range(len(texts))]
    assert sorted(tuple(r) for r in rows) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).collect() == simhash.keep_one(none).collect() == []


def test_sketches_give_similarities():
    rng = random.Random(1)
    for n, share in ((50, 0.5), (100, 0.9), (3000, 0.8), (3000, 0.0)):
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: int(n * share)] + [rng.getrandbits(64) for _ in range(n - int(n * share))]
        want = len(set(a) & set(b)) / len(set(a) | set(b))
        got = simhash.resemblance(simhash.sketch(np.array(a * 2, np.uint64)), simhash.sketch(np.array(b, np.uint64)))
        assert got == want if n < simhash.SKETCH else abs(got - want) < 0.2
    assert simhash.resemblance(b"", b"") == 1 and simhash.resemblance(b"", simhash.sketch(np.array([1], np.uint64))) == 0


def near_copy(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = "new" + str(rng.randrange(10**6))
    return out


def test_near_copies_are_caught_and_others_stay(spark):
    """Five-word similarity of 0.8 or more: nine of ten go; unrelated texts of the same words all stay."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randrange(150, 400)) for _ in range(150)]
    copies = [near_copy(rng, w, max(1, len(w) // 100)) for w in base[:100]]

    def similarity(a, b):
        x, y = (set(zip(*(w[k:] for k in range(5)))) for w in (a, b))
        return len(x & y) / len(x | y)

    assert all(similarity(a, b) >= 0.8 for a, b in zip(base, copies))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(base + copies)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df, width=2, distance=6, confirm=(5, 0.6)).collect()}
    assert set(range(150)) <= kept and len(kept) <= 160


def test_plans_grow():
    assert [simhash.plan_blocks(10**k, 3) for k in (2, 5, 8, 10)] == sorted(simhash.plan_blocks(10**k, 3) for k in (2, 5, 8, 10))
