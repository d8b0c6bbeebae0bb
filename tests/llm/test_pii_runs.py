"""Contexts of identifiers that are written with blanks."""

from __future__ import annotations

import pytest

from gridloom.llm import pii


def card(k):
    """A number of sixteen digits in groups that passes the check of cards."""
    body = f"411111111111{k:03d}"
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
    number = body + str(-total % 10)
    return " ".join(number[i : i + 4] for i in range(0, 16, 4))


PHONES = [f"you may reach us by telephone: +1 (743) 555-38{k}4 today" for k in range(5)]
CARDS = [f"paid with card no. {card(k)}, thanks" for k in range(5)]
NEW = {
    "their telephone: 0743 555 9876, at night": ("phone", "0743 555 9876"),
    "by telephone: (743) 555-1200": ("phone", "743) 555-1200"),
    "card no. 9999 8888 7777 6665 was lost": ("card", "9999 8888 7777 6665"),
    "card no. A17-22 was lost": ("card", "A17-22"),
}
PLAIN = ["page 12 of 1999 34", "zed88 12 rooms"]


def rows(spark):
    return spark.createDataFrame(list(enumerate([*PHONES, *CARDS, *NEW, *PLAIN])), "doc_id long, text string")


def test_contexts_of_phones_and_grouped_cards(spark):
    got = {r.doc_id: r.spans for r in pii.contract_rows(rows(spark)).collect()}
    for k, (text, (kind, what)) in enumerate(NEW.items(), 10):
        at = text.index(what)
        assert got[k] == f"{kind}:{at}:{at + len(what)}"
    assert all(got[k].startswith("phone:") and "," not in got[k] for k in range(5))
    assert all(got[k].startswith("card:") and "," not in got[k] for k in range(5, 10))
    assert got[14] == got[15] == ""


def test_redaction_leaves_no_part(spark):
    got = {r.doc_id: r.text for r in pii.redact(rows(spark)).collect()}
    assert got[10] == "their telephone: [PHONE], at night" and got[12] == "card no. [CARD] was lost"


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("a +1 (743) 555-38 b", ["a ", "+1 (743) 555-38 ", "b"]),
        ("12, 13 14 zed88 12 x@1 5", ["12, ", "13 14 ", "zed88 ", "12 ", "x@1 ", "5"]),
        (" 1\n2 - 3. 4 +5", [" ", "1\n", "2 - 3. ", "4 ", "+5"]),
    ],
)
def test_runs_of_numbers_are_words(spark, text, words):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(pii._words(F.col("t")).alias("w")).first().w == words
