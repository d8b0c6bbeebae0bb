"""Licences that lie across paragraphs or share their line with other words."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from gridloom.llm import licenses as li

SCANNER = li.Scanner(li.TEMPLATES, 0.8)
STORY = "Once upon a time there was a program that nobody had read.\n\nIt went its way through the woods and came to a house.\n\n"
BY_NAME = {"MIT": li._MIT, "BSD-2-Clause": f"{li._BSD_HEAD}\n{li._BSD_TAIL}", "BSD-3-Clause": f"{li._BSD_HEAD}\n{li._BSD_THIRD}\n{li._BSD_TAIL}", "Apache-2.0": li._APACHE} | {n: li._GPL.format(w, v) for n, w, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("AGPL-3.0", "Affero ", "3"), ("LGPL-3.0", "Lesser ", "3"))}


@pytest.mark.parametrize("name", BY_NAME)
def test_blank_lines_inside_a_longer_text(name):
    notice = BY_NAME[name].replace("\n", "\n\n")
    text = STORY + "Copyright (c) 2001 Somebody\n\n" + notice + "\n\n" + STORY * 3
    [found] = SCANNER.scan(text)
    assert (found.name, found.dice, text[found.start : found.end]) == (name, 1.0, notice)


def test_wrapped_and_commented():
    text = STORY + " * " + "\n * ".join(" ".join(li._MIT.split()[k : k + 9]) for k in range(0, 200, 9)) + "\n" + STORY
    [found] = SCANNER.scan(text)
    assert found.name == "MIT" and found.dice == 1.0


@pytest.mark.parametrize(
    ("line", "name", "passage"),
    [
        ("This file is part of foo. Licensed under the MIT License. See LICENSE for details.", "MIT", "Licensed under the MIT License."),
        ("Copyright (c) 2020 Foo Ltd. Licensed under the Apache License, Version 2.0.", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("# Copyright 2020 Foo, licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", "licensed under CC BY-SA 4.0."),
    ],
)
def test_lines_shared_with_other_words(line, name, passage):
    text = f"İ story.\n{line}\nMore of it."
    [found] = SCANNER.scan(text)
    assert (found.name, found.dice, text[found.start : found.end]) == (name, 1.0, passage)


def test_every_run_of_words_counts():
    """The best Dice coefficient over all runs, by brute force."""
    rng = random.Random(5)
    scanner = li.Scanner([("x", "a b c a b d"), ("y", "b c d e f g h"), ("z", "a a a b")], 0.7)
    hits = 0
    for _ in range(300):
        words = [rng.choice("aabbcd.") for _ in range(rng.randint(0, 25))]
        text = " ".join(words).replace(".", "q")
        run = text.split()
        best = 0.0
        for t in scanner.templates:
            for i in range(len(run)):
                for j in range(i + 2, len(run) + 1):
                    grams = Counter(zip(run[i:j], run[i + 1 : j]))
                    best = max(best, 2 * (grams & t.bigrams).total() / (j - i - 1 + t.size))
        found = scanner.scan(text)
        hits += bool(found)
        assert bool(found) == (best >= 0.7)
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    assert 20 < hits < 280


def test_repeats_stay_cheap():
    found = SCANNER.scan("\n\n".join([li._MIT.replace("\n", "\n\n")] * 100))
    assert [f.name for f in found] == ["MIT"] * 100


def test_a_whole_licence_above_code():
    from gridloom.llm import license_texts

    for name, text in (("Apache-2.0", license_texts.APACHE), ("Zlib", license_texts.ZLIB), ("BSL-1.0", license_texts.BOOST)):
        wrapped = "\n".join(f"   {line}" for line in text.replace(". ", ".\n\n").split("\n"))
        found = SCANNER.scan(wrapped + "\n\ndef main():\n    return 0\n" + STORY)
        assert [f.name for f in found] == [name] and found[0].dice > 0.95
