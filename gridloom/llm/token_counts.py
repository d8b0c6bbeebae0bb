"""Token counts by a compiled finite-state transducer.

The segmentation of :mod:`.spm` is compiled, as it is needed, into a deterministic
transducer over characters. A state keeps what can still matter of the text read:
for each suffix that starts some piece, the last piece in front of that suffix and
the count there, relative to the present one. A transition is annotated with the
change of the token count (a merge may lower it again). The states are finite,
because pieces are; a compiled transducer that outgrows ``STATE_LIMIT`` is dropped
between two stretches and compiled anew, as regular expression engines do.

All texts of a slice, whatever their lengths, are one stream of characters with an
end behind each text. The stream is cut into chunks of about ``CHUNK_CHARS``, which
are read side by side, one character of each at a step. Where a chunk holds a *fresh
start* (in front of a marked word, behind a character that joins nothing, behind an
end) the next one begins there, and its entry state is certain. A chunk that begins
inside a longer run of joining characters has a state map: entry states to exit state
and count of the characters up to its first fresh start. A map starts with a guess
(the state after the ``LOOK`` characters in front) and is extended by whatever states
the chunk before can hand over, in a few rounds of all chunks together; it holds a
few numbers, never text. Maps compose associatively, and a parallel prefix scan over
them gives the true entry state of every chunk. A chunk that is entered in a state
that its map still lacks is read once more, so that counts are exact whatever was
guessed.

Memory is bounded by a slice of rows, or for a longer text by that text and one
stretch of ``STRETCH`` characters; time is linear in the text.

Rows: null and empty texts have no tokens. Repeated rows, null ids and further columns
(of any name) make no difference; an empty table gives an empty one. There are no ties.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import spm
from gridloom.llm.common import held, slices

#: Characters of a chunk, of a guess, and of a stretch; states of a transducer; rounds in which state maps are extended together.
CHUNK_CHARS, LOOK, STRETCH, STATE_LIMIT, ROUNDS = 512, 48, 4_000_000, 300_000, 2
#: Classes of characters: the end of a text; those that join nothing, by their number of tokens; from JOINING on, one for each other character.
END, JOINING = 0, 5
_BIAS = 128  # of a change of the count, which is kept in a byte
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """States, and their transitions in an open hash table that whole arrays are looked up in."""

    def __init__(self, model: spm.Model) -> None:
        if model.model_type != spm.BPE:
            raise ValueError("counts are compiled for BPE models")
        self.model = model
        self.characters = [spm.MARK, *sorted(model.joining - {spm.MARK})]
        self.classes = np.repeat(np.array([1, 2, 3, 4], np.uint16), [0x80, 0x800 - 0x80, 0x10000 - 0x800, 0x110000 - 0x10000])
        for piece in model.ids:
            if len(piece) == 1:
                self.classes[ord(piece)] = 1
        self.classes[[ord(c) for c in self.characters]] = np.arange(len(self.characters), dtype=np.uint16) + JOINING
        self.classes[ord(" ")] = self.mark = JOINING
        self.reset()

    def reset(self) -> None:
        # A state: (its read-back, ((distance back, last piece there, count there less the present one), ...)).
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.near: dict[int, int] = {}  # transitions that single chunks took
        self.start = self.state(("", ((0, None, 0),)))
        self.room(14)

    def room(self, bits: int) -> None:
        """A table of 2 ** ``bits`` places, with the transitions that are known."""
        known = [] if bits == 14 else [(k, v) for k, v in zip(self.keys.tolist(), self.moves.tolist()) if k >= 0]
        self.bits, self.used = bits, 0
        self.keys, self.moves = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for k, v in known:
            self.put(k, v)

    def put(self, key: int, move: int) -> None:
        at, mask = (key * int(_MIX) & (1 << 64) - 1) >> (64 - self.bits), len(self.keys) - 1
        while self.keys[at] >= 0:
            at = at + 1 & mask
        self.keys[at], self.moves[at] = key, move
        self.used += 1
        if self.used * 4 > len(self.keys):
            self.room(self.bits + 1)

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def compile(self, state: int, kind: int) -> int:
        """The transition from a state on a class of characters: next state and change of the count in one number."""
        if kind < JOINING:
            return self.start << 8 | kind + _BIAS
        m, c = self.model, self.characters[kind - JOINING]
        back, memory = self.states[self.start if kind == self.mark and not self.states[state][0].endswith(c) else state]
        for distance, last, count in memory:  # longest first
            piece = back[len(back) - distance :] + c
            i = m.ids.get(piece, -1 - ord(c) if distance == 0 else None)
            if i is not None and m.survives(last, i):
                break
        change = count + m.size_of(piece)
        kept = tuple((d + 1, p, n - change) for d, p, n in memory if back[len(back) - d :] + c in m.prefixes)
        far = max((d for d, _, _ in kept), default=0)
        after = self.state(((back + c)[len(back) + 1 - far :], (*kept, (0, i, 0))))
        if not -_BIAS <= change < _BIAS:
            raise ValueError("a piece is too long")
        return after << 8 | change + _BIAS

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of (state << 16 | class), compiled where that was not done yet."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        moves = self.moves[at]
        rest = np.flatnonzero(there != keys)
        while len(rest):
            lost = rest[there[rest] < 0]
            if len(lost):
                wanted, place = np.unique(keys[lost], return_inverse=True)
                made = [self.compile(k >> 16, k & 0xFFFF) for k in wanted.tolist()]
                moves[lost] = np.array(made, np.int64)[place]
                for k, v in zip(wanted.tolist(), made):
                    self.put(k, v)
                if len(self.keys) != mask + 1:  # the table has grown: the others begin again
                    rest = rest[there[rest] >= 0]
                    moves[rest] = self.look_up(keys[rest])
                    return moves
                rest = rest[there[rest] >= 0]
            at[rest] = at[rest] + 1 & mask
            there[rest] = self.keys[at[rest]]
            moves[rest] = self.moves[at[rest]]
            rest = rest[there[rest] != keys[rest]]
        return moves

    def run(self, kinds: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """Read chunks side by side; changes (plus ``_BIAS``) go to the place of their character. The chunks' exit states."""
        order = np.argsort(-size, kind="stable")
        at, state = first[order], entry[order].astype(np.int64)
        steps = int(size.max(initial=0))
        live = np.searchsorted(-size[order], -np.arange(steps), side="left")  # chunks longer than so many characters
        for n in live.tolist():
            here = at[:n]
            moves = self.look_up(state[:n] << 16 | kinds[here])
            state[:n] = moves >> 8
            changes[here] = moves.astype(np.uint8)
            here += 1
        out = np.empty_like(state)
        out[order] = state
        return out


    def walk(self, kinds: np.ndarray, state: int) -> tuple[int, int]:
        """Read one chunk: its exit state and count."""
        count = 0
        for kind in kinds.tolist():
            key = state << 16 | kind
            move = self.near.get(key)
            if move is None:
                move = self.near[key] = int(self.look_up(np.array([key]))[0])
            state = move >> 8
            count += (move & 255) - _BIAS
        return state, count


#: What a stretch without a fresh start does, by entry state: exit state (or -1 where a fresh start follows) and count.
StateMap = dict[int, tuple[int, int]]


def compose(a: StateMap, b: StateMap) -> StateMap:
    """First ``a``, then ``b``, for the entry states that both are known for."""
    return {e: (b[x][0], n + b[x][1]) for e, (x, n) in a.items() if x in b}


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Maps of all prefixes; each round is independent work, the rounds are logarithmic in number."""
    step = 1
    while step < len(maps):
        maps = [m if k < step else compose(maps[k - step], m) for k, m in enumerate(maps)]
        step *= 2
    return maps


class Counter:
    """Chunks, their state maps and counts."""

    def __init__(self, model: spm.Model) -> None:
        self.model = model
        self.transducer = Transducer(model)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        entry, parts, owners, room = self.transducer.start, [], [], STRETCH
        for k, t in enumerate(texts):
            if not t:
                continue
            at = 0
            while at < len(t):
                part = t[at : at + room]
                parts.append((spm.MARK if self.model.dummy_prefix and not at else "") + part)
                owners.append(k)
                at += len(part)
                room -= len(part)
                if room <= 0:
                    entry = self._stretch(parts, owners, at < len(t), entry, out)
                    parts, owners, room = [], [], STRETCH
        if parts:
            self._stretch(parts, owners, False, entry, out)
        return out.tolist()

    def _stretch(self, parts: list[str], owners: list[int], open_end: bool, entry: int, out: np.ndarray) -> int:
        """Add the tokens of a part of the stream; a new text begins with each part but the first. The state behind it."""
        t = self.transducer
        if len(t.states) > STATE_LIMIT:
            kept = t.states[entry]
            t.reset()
            entry = t.state(kept)
        text = "\n".join(parts) + ("" if open_end else "\n")
        kinds = t.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        edges = np.cumsum([0] + [len(p) + 1 for p in parts])
        kinds[edges[1 : None if not open_end else -1] - 1] = END
        n = len(kinds)
        mark = kinds == t.mark
        fresh = np.empty(n + 1, bool)
        fresh[0], fresh[-1] = entry == t.start, True
        fresh[1:-1] = (kinds[:-1] < JOINING) | (mark[1:] & ~mark[:-1])
        begin = np.flatnonzero(fresh)
        grid = np.arange(0, n, CHUNK_CHARS)
        place = np.searchsorted(begin, grid, side="right") - 1  # the last fresh start up to there, if any
        near = np.where(place >= 0, begin[place], -1)
        first = np.where(near > grid - CHUNK_CHARS, near, grid)
        first[0] = 0
        sure = fresh[first]
        sure[0] = True  # its entry state is known, if not fresh
        size = np.diff(np.append(first, n))
        changes = np.empty(n, np.uint8)
        entries = np.full(len(first), t.start)
        entries[0] = entry
        guess = np.flatnonzero(~sure)
        if len(guess):
            look = np.minimum(LOOK, first[guess])
            entries[guess] = t.run(kinds, first[guess] - look, look, np.full(len(guess), t.start), changes)
        exits = t.run(kinds, first, size, entries, changes)
        totals = np.add.reduceat(changes, edges[:-1], dtype=np.int64) - _BIAS * np.diff(np.append(edges[:-1], n))
        if len(guess):
            ends = begin[np.searchsorted(begin, first[guess], side="right")]  # the first fresh start behind
            heads = np.minimum(ends - first[guess], size[guess])
            reach = heads < size[guess]
            whole = exits[guess].copy()
            whole[reach] = -1
            sums = self._sums(changes, first[guess], heads)
            maps = [{e: (x, c)} for e, x, c in zip(entries[guess].tolist(), whole.tolist(), sums.tolist())]
            self._extend(kinds, guess, first[guess], heads, reach, exits, maps)
            exits[-1] = self._correct(kinds, guess, first[guess], heads, reach, edges, exits, maps, sums, totals)
        np.add.at(out, np.array(owners), totals)
        return int(exits[-1]) if open_end else t.start

    @staticmethod
    def _sums(changes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        lanes = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(lanes)) - np.repeat(np.cumsum(size) - size, size) + first[lanes]
        return np.bincount(lanes, changes[at].astype(np.float64), len(first)).astype(np.int64) - _BIAS * size

    def _extend(self, kinds: np.ndarray, guess: np.ndarray, first: np.ndarray, heads: np.ndarray, reach: np.ndarray, exits: np.ndarray, maps: list[StateMap]) -> None:
        """Extend the maps by what the chunk before hands over; all chunks together, in rounds."""
        place = {int(g): k for k, g in enumerate(guess)}
        scratch = np.empty(len(kinds), np.uint8)
        for _ in range(ROUNDS):
            wanted = []
            for k, g in enumerate(guess.tolist()):
                before = place.get(g - 1)
                handed = {int(exits[g - 1])} if before is None else {x for x, _ in maps[before].values()} - {-1}
                wanted += [(k, e) for e in handed - maps[k].keys()]
            if not wanted:
                return
            while wanted:  # a chunk's states one after the other: they share the place of its changes
                now, rest, busy = [], [], set()
                for k, e in wanted:
                    (rest if k in busy else now).append((k, e))
                    busy.add(k)
                lanes, states = np.array([k for k, _ in now]), np.array([e for _, e in now])
                after = self.transducer.run(kinds, first[lanes], heads[lanes], states, scratch)
                for (k, e), x, c in zip(now, after.tolist(), self._sums(scratch, first[lanes], heads[lanes]).tolist()):
                    maps[k][e] = (-1 if reach[k] else x, c)
                wanted = rest

    def _correct(self, kinds: np.ndarray, guess: np.ndarray, first: np.ndarray, heads: np.ndarray, reach: np.ndarray, edges: np.ndarray, exits: np.ndarray, maps: list[StateMap], sums: np.ndarray, totals: np.ndarray) -> int:
        """Put true counts of the guessed chunks into the totals; the true state behind the last chunk.

        What the maps still lack of the way from the true entry is read one chunk after the other.
        """
        last = int(exits[-1])
        for run in np.split(np.arange(len(guess)), np.flatnonzero(np.diff(guess) > 1) + 1):
            e = state = int(exits[guess[run[0]] - 1])
            for k, prefix in zip(run.tolist(), scan([maps[k] for k in run])):
                if state not in maps[k]:
                    after, count = self.transducer.walk(kinds[first[k] : first[k] + heads[k]], state)
                    maps[k][state] = (-1 if reach[k] else after, count)
                totals[np.searchsorted(edges, first[k], side="right") - 1] += maps[k][state][1] - sums[k]
                state = prefix[e][0] if e in prefix else maps[k][state][0]
            if guess[run[-1]] == len(exits) - 1 and state >= 0:
                last = state
        return last


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    data = spm.read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("counter", data), lambda: Counter(spm.Model.parse(data)))
        for part, texts in slices(batches, "t", STRETCH, keep=True):
            sizes = pa.compute.binary_length(part.column("t")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("k"), sizes, pa.array(counter.counts(texts), pa.int64())], ["k", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
