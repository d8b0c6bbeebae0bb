from __future__ import annotations

from collections import Counter

import pytest

from gridloom.llm import licenses as li


def dice(a, b):
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / max(1, x.total() + y.total())


def words(text):
    return li.Scanner._words(text)


def passages(text):
    """All texts, paragraphs and lines, longest first."""
    yield text
    for paragraph in text.split("\n\n"):
        yield paragraph
        yield from paragraph.split("\n")


def test_bounds_lose_nothing():
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    texts = [t for _, t in li.TEMPLATES] + ["Released under MIT License", "Licensed under the Apache Licence, version 2.0", "a b c", "", "Licensed under CC BY", li._MIT + " extra words here", li._APACHE[:300]]
    for text in texts:
        w = words(text)
        all_ = sorted((-dice(w, words(t)), name) for name, t in li.TEMPLATES)
        want = all_[0] if all_ and -all_[0][0] >= 0.8 else None
        got = scanner.best(w)
        assert (got is None) == (want is None)
        if got:
            assert got[1] == pytest.approx(-want[0]) and got[0] == want[1]


def test_every_template_finds_itself():
    scanner = li.Scanner(li.TEMPLATES, 0.9)
    for name, text in li.TEMPLATES:
        [found] = scanner.scan(text)
        assert (found.name, found.dice, found.start, found.end) == (name, 1.0, 0, len(text))


def test_places_in_a_text():
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    text = "Some story.\nLicensed under CC BY-NC 4.0.\nMore.\n\nCopyright (c) 2001 Somebody\n" + li._MIT + "\n\nReleased under the MIT License."
    found = scanner.scan(text)
    assert [f.name for f in found] == ["CC-BY-NC-4.0", "MIT", "MIT"]
    assert text[found[0].start : found[0].end] == "Licensed under CC BY-NC 4.0."
    assert scanner.scan("all work and no play " * 500) == [] == scanner.scan("\n\n\n")


def test_columns(spark):
    rows = [(1, "Released under the MIT License.", 5), (1, "Released under the MIT License.", 5), (None, None, 1), (2, "", 2), (3, "word " * 60_000 + "\nLicensed under CC BY 4.0.", 3)]
    got = li.summary(li.scan(spark.createDataFrame(rows, "doc_id long, text string, found int"))).collect()
    assert sorted((r.doc_id or 0, r.n_passages, r.licenses, r.best) for r in got) == [(0, 0, "", None), (1, 1, "MIT", "MIT"), (1, 1, "MIT", "MIT"), (2, 0, "", None), (3, 1, "CC-BY-4.0", "CC-BY-4.0")]
    assert li.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        li.Scanner(li.TEMPLATES, 0)


def test_documents(spark):
    """Lines of the documents that name a licence, and no others."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in li.summary(li.scan(docs)).where("n_passages > 0").collect()}
    assert got == {r.doc_id for r in docs.collect() if re.search(r"(?im)^\W*(this work is )?(licensed|released) under", r.text or "")}
