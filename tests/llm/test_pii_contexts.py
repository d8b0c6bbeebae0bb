"""Contexts behind identifiers and on both sides of them; recall and precision on planted ones."""

from __future__ import annotations

import random

from gridloom.llm import common, pii
from gridloom.metrics import Watch


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def added(spark, texts):
    """What context adds to the spans by form: {(document, kind, words)}."""
    out = set()
    for r in pii.find(frame(spark, texts)).collect():
        out |= {(r.id, pii.KINDS[s.rank], texts[r.id][s.start : s.end]) for s in set(r.spans) - set(r.base)}
    return out


LEFT = ["so", "then", "later", "and", "today", "once", "thus", "maybe"]


def test_words_behind(spark):
    texts = [f"{LEFT[k]} user{k}@site.org wrote back" for k in range(5)] + ["first zoe_55 wrote back", "9 came back", "we wrote back"]
    assert added(spark, texts) == {(5, "email", "zoe_55")}


def test_words_on_both_sides(spark):
    texts = [f"call +1 (743) 555-38{k}4 now" for k in range(5)] + ["call 0743-555 now"]
    texts += [f"call {k} friends" for k in range(20)] + [f"it is {k} now" for k in range(20)]
    assert added(spark, texts) == {(5, "phone", "0743-555")}


def corpus(seed=3, n=400):
    """Filler with seeds and unseen identifiers in telling contexts, and look-alikes in others: (texts, what has to be found)."""
    rng = random.Random(seed)
    filler = ["river", "stone", "7", "light", "page 12", "green", "A4", "walk", "over", "b2b", "small", "1999", "hill"]
    frames = [("email", "reach me under {} any time", "{}"), ("phone", "my telephone is {} at home", "{}"), ("ip", "request from {} refused", "{}")]
    form = {"email": lambda: f"u{rng.randrange(10**6)}@h{rng.randrange(99)}.org", "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    unseen = {"email": lambda: f"u{rng.randrange(10**6)}-at-h{rng.randrange(99)}", "phone": lambda: f"0{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}", "ip": lambda: f"host{rng.randrange(10**5)}"}
    texts, want = [], set()
    for k in range(n):
        words = [rng.choice(filler) for _ in range(30)]
        kind, around, _ = rng.choice(frames)
        told = k % 5 == 0
        what = (unseen if told else form)[kind]()
        if told:
            want.add((k, kind, what))
        texts.append(" ".join(words[:15]) + " . " + around.format(what) + " . " + " ".join(words[15:]))
    return texts, want


def test_recall_and_precision(spark):
    texts, want = corpus()
    got = added(spark, texts)
    assert len(want) == 80
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_filtered_shuffles_say_the_same(spark, monkeypatch):
    texts, _ = corpus(n=100)
    want = added(spark, texts)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert want and added(spark, texts) == want
    monkeypatch.setattr(pii, "FILTER_BITS", 64)
    assert added(spark, texts) == want


def test_shuffles_carry_no_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rng = random.Random(5)
    seeds = " . ".join(f"mail: u{k}@site.org" for k in range(9))
    text = seeds + " " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(8000))
    with Watch(spark) as w:
        pii.contract_rows(frame(spark, [text])).collect()
    assert w.totals.shuffle_write_mb < 8  # the text has 90 KB, each of whose words has five patterns


def test_clashing_columns(spark):
    row = {"doc_id": 1, "text": "me@here.org", "__id": 2, "__h": 3, "__base": "x", "__added": 4, "base": 5, "a.b": 6, "id2": 7}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'long'}" for k, v in row.items()))
    out = pii.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == tuple((row | {"text": "[EMAIL]"}).values())
