"""SentencePiece model files and the forward pass over a trie of marked words.

A model file is read with a small reader of its wire format. Pieces never hold a
word mark after another character (checked), so a text falls into *units*: a run
of marks with the word behind it. Units are encoded independently of each other.

Forward pass. Units are sorted, so that the walk over them is a depth-first
traversal of their trie: the states of the prefix that a unit shares with the one
before it stay on the stack and only the rest is computed. State ``i`` keeps the
best way to segment the first ``i`` characters.

* Unigram models: the score is the sum of the piece scores (plain Viterbi).
* BPE models: pieces carry no score of their own, but a sequence of pieces is what
  the merges give for its text exactly if that holds for each adjacent pair: merges
  inside two pieces keep their order whatever stands around them, and a merge across
  a border would already happen in the pair alone. Transitions therefore score 0
  where the pair survives its own merging and minus infinity elsewhere; one way
  into each state is left, and it is the library's segmentation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

MARK = "▁"

# Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Pairs of pieces whose verdict is remembered; beyond that, the memory is cleared.
PAIR_MEMORY = 200_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = struct.unpack("<d", data[at : at + 8])[0], at + 8
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield key >> 3, value


@dataclass
class Model:
    """Pieces of a model file and what encoding needs of its settings."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    pair_memory: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that reach over the start of a word")
        #: Proper prefixes of pieces: the inner nodes of the piece trie.
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p))}
        #: Characters that are part of longer pieces; around any other one, nothing merges.
        self.joining = {c for p in self.ids if len(p) > 1 for c in p}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds = [], [], []
        settings: dict = {}
        for number, value in _fields(data):
            if number == 1:
                item = dict(_fields(value))
                pieces.append(item[1].decode())
                scores.append(item.get(2, 0.0))
                kinds.append(item.get(3, NORMAL))
            elif number == 2:
                settings["model_type"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that keep their input's characters and spaces are supported")
                settings["dummy_prefix"] = bool(rules.get(3, 1))
        if settings.get("model_type", UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, scores, kinds, **settings)

    def marked(self, text: str) -> str:
        """The form that is segmented: blanks become marks, one more stands in front."""
        return text and (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def unit_pattern(self) -> str:
        """A regular expression whose matches are the units of a marked text."""
        return f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.joining else f"{MARK}*[^{MARK}]+|{MARK}+"

    def size_of(self, piece: str) -> int:
        """Tokens that a piece, or a character without one, is written as."""
        return 1 if piece in self.ids else len(piece.encode())

    def merged(self, text: str) -> list[str]:
        """What merging the characters of a short text gives: best score first, then leftmost."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def text_of(self, i: int) -> str:
        """The piece of an id; a character without a piece has the id -1 less its code point."""
        return self.pieces[i] if i >= 0 else chr(-1 - i)

    def survives(self, left: int | None, right: int) -> bool:
        """Whether two adjacent pieces stay apart when their text is merged."""
        if left is None:
            return True
        known = self.pair_memory.get(key := left * (1 << 24) + right)
        if known is None:
            if len(self.pair_memory) >= PAIR_MEMORY:
                self.pair_memory.clear()
            a, b = self.text_of(left), self.text_of(right)
            known = self.pair_memory[key] = self.merged(a + b) == [a, b]
        return known

    def segment(self, units: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(unit, its ids) of sorted distinct units, by one traversal of their trie.

        For each prefix the stack holds the id of the last piece, where that begins, the
        score, and the nodes of the piece trie that suffixes of the prefix lead to.
        """
        root, scores, bpe, survives, pairs = self.trie, self.scores, self.model_type == BPE, self.survives, self.pair_memory
        last: list[int | None] = [None]
        begin, best, active = [0], [0.0], [[]]
        before = ""
        for unit in units:
            shared, most = 0, min(len(unit), len(before))
            while shared < most and unit[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], best[shared + 1 :], active[shared + 1 :]
            for end in range(shared, len(unit)):  # of the prefix in front of the character
                c = unit[end]
                chosen, at, score, nodes = None, end, 0.0, []
                for start, node in (*active[end], (end, root)):  # long pieces first
                    node = node.get(c)
                    if node is None:
                        continue
                    nodes.append((start, node))
                    i = node.get("")
                    if i is None:
                        continue
                    if bpe:
                        if chosen is None:
                            left = last[start]
                            known = True if left is None else pairs.get(left * (1 << 24) + i)
                            if known or (known is None and survives(left, i)):
                                chosen, at = i, start
                    elif chosen is None or best[start] + scores[i] > score:
                        chosen, at, score = i, start, best[start] + scores[i]
                if chosen is None or (not bpe and at < end and "" not in root.get(c, ()) and best[end] + self.unknown_score > score):
                    chosen, at, score = -1 - ord(c), end, best[end] + self.unknown_score
                last.append(chosen)
                begin.append(at)
                best.append(score)
                active.append(nodes)
            out, end = [], len(unit)
            while end:
                i = last[end]
                if i < 0:
                    out.extend(self.byte_ids[b] for b in reversed(chr(-1 - i).encode()))
                else:
                    out.append(i)
                end = begin[end]
            out.reverse()
            yield unit, out
            before = unit


def read_model(path: str) -> bytes:
    """Bytes of a model file on the driver; they are sent to the tasks (vocabularies have a fixed size)."""
    with open(path, "rb") as f:
        return f.read()
