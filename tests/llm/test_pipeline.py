from __future__ import annotations

from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from gridloom.lineage import shared_dir
from gridloom.llm import entries, simhash, spm
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute_fingerprint

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(9001, "12 34", "en", "s", 5), (9002, "", "en", "s", 0), (9003, None, None, None, None), (None, "the and of the with and this", None, None, 7)], SCHEMA)
    docs = docs.unionByName(odd)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        rows = made.collect()
        docs = spark.createDataFrame(rows, made.schema)
        out.append(rows)
    return out


def test_columns(steps):
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(steps):
    gone = {r.doc_id for r in steps[0]} - {r.doc_id for r in steps[1]}
    assert gone == {9001, 9002, 9003}


def test_near_duplicates(steps):
    rows = sorted(steps[1], key=lambda r: (r.doc_id is None, r.doc_id))
    fps = [brute_fingerprint(r.text, 2) for r in rows]
    grams = [simhash.sketch(simhash.shingle_hashes(r.text, 5)) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if fps[i] == fps[j] or ((fps[i] ^ fps[j]).bit_count() <= corpus_pipeline.BITS and simhash.resemblance(grams[i], grams[j]) >= corpus_pipeline.ALIKE):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert sorted(map(repr, steps[2])) == sorted(repr(rows[k]) for k in set(root))


def test_decontamination(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} - {()}
    sizes = sorted({len(w) for w in windows})

    def contaminated(text):
        w, hit = words(text), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert {r.doc_id for r in steps[2] if not contaminated(r.text)} == {r.doc_id for r in steps[3]}
    assert len(steps[3]) < len(steps[2])


def test_personal_data(steps):
    before = {r.doc_id: r for r in steps[3]}
    changed = 0
    for r in steps[4]:
        old = before.pop(r.doc_id)
        assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, len(r.text))
        changed += r.text != old.text
        assert "@mail" not in r.text
    assert not before and changed


def test_tokens(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=entries.tokenizer_path())
    texts = {r.doc_id: r.text for r in steps[4]}
    assert len(steps[5]) == len(texts)
    for r in steps[5]:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_run(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
    assert len([p for p in set(folder.iterdir()) - before if len(p.name) == 32]) == 1  # what the last stage reads
    assert spm.read_model(entries.tokenizer_path())


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []
