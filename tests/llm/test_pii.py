from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, form) in enumerate(FORMS.items()) for m in re.finditer(form, text or "") if valid(name, m.group()))
    return [sum(s[3] == n for s in spans) for n in FORMS], ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)


TEXTS = [
    "", None, "a@b.c@d.e f", "a@b.cd+x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.04 1.2.3.256 1.2.3.4é", "4111 1111 1111 1111, 4111-1111-1111-1111 é 4111111111111111 4111111111111112 4 1 1",
    "+1 (555) 123-4567 +123 +1.2.3.4.5.6.7.8.9.0) x +1+2345678901 +12345678901234567890", "x@@y.z..w a@b a@b. é@x.y ñ.a@x-y.z- 🙂me@here.org🙂", "1" * 4000 + " " + "a" * 4000 + "@" + " " + "a." * 2000, "1.2.3.4@x.y +1234567890@a.bc",
    "mail: %+-._@a-b.c-d.e_f", "9" * 15 + " " + "0" * 16 + " " + "0" * 14, "+1 ((((((((((((((((((", "x@" + "a." * 30_000 + "b", "4 " * 30_000, "!" * 30_000 + "7", "word " * 40_000 + "end@of.text",
]


def test_forms(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, h int")
    rows = pii.contract_rows(df).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        counts, spans = brute(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, TEXTS[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.contract_rows(docs).collect():
        counts, spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.spans == spans  # no context tells more here


CONTEXT = [f"Please write to account mailbox: user{k}@site.org today" for k in range(5)] + ["and his mailbox: bob77-at-site is full", "the mailbox: (zed88), too", "room 12 and page 34 of 56", "and more of 78", "account mailbox: someone9"]


def test_contexts_find_what_forms_do_not(spark):
    df = spark.createDataFrame(list(enumerate(CONTEXT)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.contract_rows(df).collect()}

    def place(k, word):
        return f"email:{CONTEXT[k].index(word)}:{CONTEXT[k].index(word) + len(word)}"

    assert got[5] == place(5, "bob77-at-site") and got[6] == place(6, "zed88") and got[9] == place(9, "someone9")
    assert got[7] == got[8] == "" and all(got[k] == brute(CONTEXT[k])[1] for k in range(5))


def test_patterns_that_precede_other_words_tell_nothing(spark):
    texts = [f"see mailbox: u{k}@site.org" for k in range(4)] + ["mailbox: code9"] + ["mailbox: empty"] * 20
    rows = pii.contract_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in rows}[4] == ""


def test_redaction(spark):
    rows = [(1, "mail a@b.cd, or +1 (555) 123-4567é", "k"), (1, "mail a@b.cd, or +1 (555) 123-4567é", "k"), (2, "", "k"), (3, None, "k"), (None, "9.9.9.9", "k"), (4, "clean text", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "[IP]"), (1, "mail [EMAIL], or [PHONE]é"), (1, "mail [EMAIL], or [PHONE]é"), (2, ""), (3, ""), (4, "clean text")]
    assert {r.doc_id: r.text for r in out.collect()}[3] is None
    context = pii.redact(spark.createDataFrame(list(enumerate(CONTEXT)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in context.collect()}[6] == "the mailbox: ([EMAIL]), too"


def test_overlapping_spans_are_one_gap(spark):
    df = spark.createDataFrame([("ab1.2.3.4cd", [(2, 1, 9), (4, 2, 10)])], "t string, s array<struct<start:int,rank:int,end:int>>")
    assert df.select(pii.redacted(F.col("t"), F.col("s")).alias("r")).first().r == "ab[IP]d"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.contract_rows(none).collect() == pii.redact(none).collect() == []


def test_no_python_runs_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", pii.contract_rows(df)._jdf.queryExecution().toString())


@pytest.mark.parametrize(("s", "good"), [("0.0.0.0", True), ("255.255.255.255", True), ("256.1.1.1", False), ("000255.1.1.1", True), ("1.1.1.999999999999", False)])
def test_parts_of_addresses(spark, s, good):
    assert spark.createDataFrame([(s,)], "s string").select(pii.valid("ip", F.col("s")).alias("v")).first().v is good
