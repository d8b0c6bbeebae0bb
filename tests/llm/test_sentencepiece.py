from __future__ import annotations

import functools
import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import sentencepiece_codec as codec
from gridloom.llm import spm, token_counts
from gridloom.llm.entries import tokenizer_path

HARD = ["", " ", "  a b\tc\n\nd  ", "a" * 3000, "日本語 テキスト\n  x  y   z\n", "x   \n   y", " \n ", "▁▁a▁", "Ａ ﬁ é é \x00 　 x y <s> <unk> </s> <0x41>", "🙂🙂 🙂", "\r\n\r\n", "don't stop. 12,345.67 (e.g.)…"]


@pytest.fixture(scope="module")
def model():
    path = tokenizer_path()
    return SimpleNamespace(path=path, data=spm.read_model(path), library=sentencepiece.SentencePieceProcessor(model_file=path))


def corpus(spark, n=150):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(n).collect()]


def test_ids_are_the_librarys(spark, model):
    texts = corpus(spark) + HARD
    got = codec.Encoder(model.data).encode(texts)
    assert [g.tolist() for g in got] == model.library.encode(texts)


def test_decoding_gives_the_text_back(spark, model):
    texts = corpus(spark) + HARD
    decoder = codec.Decoder(spm.Model.parse(model.data))
    for text, ids in zip(texts, codec.Encoder(model.data).encode(texts)):
        assert decoder.decode(ids) == text.replace(spm.MARK, " ") == model.library.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n▁abcdeéhinorst.,'10日🙂\x00", max_size=40), max_size=4))
def test_any_texts(texts):
    data = spm.read_model(tokenizer_path())
    library = _library()
    want = [library.encode(t) for t in texts]
    assert [g.tolist() for g in codec.Encoder(data).encode(texts)] == want
    counter = _counter()
    assert counter.counts(texts) == list(map(len, want))


@functools.cache
def _library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@functools.cache
def _counter():
    return token_counts.Counter(spm.Model.parse(spm.read_model(tokenizer_path())))


def test_the_walk_shares_prefixes(model):
    m = spm.Model.parse(model.data)
    units = sorted({"▁then", "▁there", "▁thereof", "▁the", "▁other", "▁"})
    got = dict(m.segment(units))
    assert {u: got[u] for u in units} == {u: dict(m.segment([u]))[u] for u in units}


def test_unigram_scores_take_the_best_path():
    """A small model with scores: every segmentation is tried."""
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "ba": -2.0, "▁ab": -6.0, "bab": -4.4}
    names = [f"<0x{k:02X}>" for k in range(256)] + list(pieces)
    m = spm.Model(names, [0.0] * 256 + list(pieces.values()), [spm.BYTE] * 256 + [spm.NORMAL] * len(pieces), spm.UNIGRAM)

    def best(text):
        if not text:
            return 0.0
        options = [m.scores[m.ids[text[:k]]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in m.ids]
        if text[0] not in m.ids:
            options.append(m.unknown_score + best(text[1:]))
        return max(options)

    units = sorted({"▁abab", "▁ba", "▁aab", "▁b", "▁abx", "▁ababba", "▁xa"})
    for unit, ids in m.segment(units):
        score = sum(m.unknown_score if i < 256 else m.scores[i] for i in ids)
        assert score == pytest.approx(best(unit))
        assert codec_text(m, ids) == unit


def codec_text(m, ids):
    return b"".join(bytes([i]) if i < 256 else m.pieces[i].encode() for i in ids).decode()


UNBROKEN = ["a" * 5000, "ab" * 3001, "the" * 2000, "thequickbrownfoxjumpsoverthelazydog" * 150, "ininininin" * 300 + " x " + "tion" * 900, "日本語テキスト" * 400]


@pytest.mark.parametrize("chunk, look, stretch, rounds", [(1, 3, 50, 6), (2, 1, 7, 0), (7, 0, 1000, 1), (50, 5, 1 << 20, 6), (512, 48, 1 << 20, 6)])
def test_chunks_compose(model, monkeypatch, chunk, look, stretch, rounds):
    """Whatever is guessed about the states between chunks, and wherever texts are cut."""
    for name, value in (("CHUNK_CHARS", chunk), ("LOOK", look), ("STRETCH", stretch), ("ROUNDS", rounds)):
        monkeypatch.setattr(token_counts, name, value)
    texts = [*HARD, "the quick  brown\nfox " * 30, *([u[:600] for u in UNBROKEN] if chunk < 50 else UNBROKEN)]
    assert token_counts.Counter(spm.Model.parse(model.data)).counts(texts) == list(map(len, model.library.encode(texts)))


def test_state_maps_hold_numbers_and_compose_associatively():
    a, b, c = {1: (2, 5), 3: (4, 6)}, {2: (7, -1), 4: (7, 1)}, {7: (9, 3)}
    assert token_counts.compose(token_counts.compose(a, b), c) == token_counts.compose(a, token_counts.compose(b, c)) == {1: (9, 7), 3: (9, 10)}
    assert token_counts.scan([a, b, c]) == [a, {1: (7, 4), 3: (7, 7)}, {1: (9, 7), 3: (9, 10)}]


def test_memory_is_linear_in_a_text_without_blanks(model):
    """What is held besides the text grows no faster than the text does."""
    import tracemalloc

    counter = token_counts.Counter(spm.Model.parse(model.data))
    unit, peaks = "thequickbrownfoxjumpsoverthelazydog", []
    counter.counts([unit * 1000])
    for n in (10_000, 40_000):
        tracemalloc.start()
        counter.counts([unit * n])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0]


def test_a_full_transducer_is_compiled_anew(model, monkeypatch):
    monkeypatch.setattr(token_counts, "STATE_LIMIT", 10)
    monkeypatch.setattr(token_counts, "STRETCH", 20)
    texts = ["Several words, more than ten states of them." * 3, "andoneofthemunbroken" * 9]
    assert token_counts.Counter(spm.Model.parse(model.data)).counts(texts) == list(map(len, model.library.encode(texts)))


ROWS = [(1, "hello world", 7), (1, "hello world", 7), (None, None, 8), (2, "", 9), (3, "long " * 30_000, 1)]


def test_columns(spark, model):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, model.path).collect()))
    sizes = {t: len(model.library.encode(t or "")) for _, t, _ in ROWS}
    assert got == sorted((i or 0, len((t or "").encode()), sizes[t], sizes[t] > 4096) for i, t, _ in ROWS)
    trip = codec.round_trip(df, model.path).collect()
    assert len(trip) == len(ROWS) and all(r.round_trip for r in trip)
    assert {r.ids_sha256 for r in trip if r.doc_id == 1} == {hashlib.sha256(np.array(model.library.encode("hello world"), "<i4").tobytes()).hexdigest()}
    ids = codec.encode(df, model.path)
    assert {tuple(r.ids) if r.ids is not None else None for r in ids.collect()} == {None if t is None else tuple(model.library.encode(t)) for _, t, _ in ROWS}
    back = codec.decode(ids.withColumnRenamed("ids", "x"), model.path, ids_col="x")
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in ROWS)


def test_empty_tables(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(df, model.path).collect() == codec.round_trip(df, model.path).collect() == codec.encode(df, model.path).collect() == []


def test_memory_has_two_generations():
    from gridloom.llm.common import Memory

    made = []

    def make(xs):
        made.extend(xs)
        return [(x, len(x)) for x in xs]

    memory = Memory(3, 5)
    for wanted in ({"a", "b", "c", "d"}, {"a", "e"}, {"a", "longer word"}, {"x", "y", "z", "w", "v", "u", "t", "s"}, {"a"}):
        assert {x: memory.of(wanted, make)[x] for x in wanted} == {x: len(x) for x in wanted}
    assert len(memory.young) <= 6 and "longer word" not in memory.young
