"""Progressive JPEG in numpy: coefficients to files and back, and to RGB.

Files are written with 4:2:0 sampling, a quantisation of one, restart intervals of
``RESTART`` units, and these scans: all DC values without their lowest bit, for each
component two bands of AC coefficients without theirs, then the lowest bits of each.

Reading works scan by scan on many files at a time. Restart intervals do not depend on
each other, so that each is a lane and a step decodes one symbol in every lane. A file
from elsewhere (other samplings, tables, bands, runs of empty blocks, no restarts) is
read by the same code with fewer lanes. Sizes need not be whole units. Sequential files,
and broken ones, are not read, and do not keep others from being read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

RESTART = 4

# Fixed values of the format: markers.
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
_NEXT_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each coefficient in the order of the file."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def idct_matrix(scale: int = 4096) -> np.ndarray:
    """(64, 64): a block in the order of the file, times this, is its samples times ``scale``.

    Whole numbers, so that sums of single precision are exact and no batch differs.
    """
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(both[zigzag()] * scale).astype(np.float32)


class Code:
    """A prefix code, from the number of codes of each length and their symbols."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.lookup = np.zeros(65536, np.uint16)  # length * 256 + symbol, by the next 16 bits
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                s = symbols[at]
                self.code[s], self.size[s] = code, length
                self.lookup[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + s
                code, at = code + 1, at + 1
            code <<= 1

    def segment(self, kind: int) -> bytes:
        return bytes([kind]) + self.counts + self.symbols


def _code(lengths: dict[int, Iterable[int]]) -> Code:
    groups = {n: bytes(s) for n, s in lengths.items()}
    return Code(bytes(len(groups.get(n, b"")) for n in range(1, 17)), b"".join(groups[n] for n in sorted(groups)))


#: DC sizes all alike; AC symbols (run * 16 + size): short codes for the sizes that letters have.
DC_CODE = _code({4: range(12)})
_SHORT = {1: [4], 2: [3], 3: [6], 4: [5], 7: [0, 1, 2]}
AC_CODE = _code(_SHORT | {13: [16 * r + s for r in range(16) for s in range(11) if 16 * r + s > 6 or 16 * r + s not in {x for v in _SHORT.values() for x in v}]})

_SIZE = np.array([int(k).bit_length() for k in range(4096)], np.int64)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits) of non-zero values, or of zero: (0, 0)."""
    size = _SIZE[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


@dataclass
class Shape:
    """Blocks of a run of images: where each component's blocks stand in one array, image after image."""

    width: np.ndarray  # units (MCUs) across and down, of each image
    height: np.ndarray
    sampling: tuple[tuple[int, int], ...] = ((2, 2), (1, 1), (1, 1))
    size: np.ndarray | None = None  # (images, 2): rows and columns of pixels, where these are no whole units

    def __post_init__(self) -> None:
        units = self.width * self.height
        self.units = np.concatenate([[0], np.cumsum(units)])
        image = np.repeat(np.arange(len(units)), units)
        local = np.arange(self.units[-1]) - self.units[image]
        w = self.width[image]
        row, column = local // np.maximum(w, 1), local % np.maximum(w, 1)
        self.first, parts = [], []  # blocks of a component in front of each image; block numbers by unit
        at = 0
        for h, v in self.sampling:
            first = at + self.units * (h * v)
            self.first.append(first)
            for b in range(v):
                for a in range(h):
                    parts.append(first[image] + (row * v + b) * (w * h) + column * h + a)
            at = int(first[-1])
        self.blocks = at
        self.order = np.stack(parts, axis=1) if len(image) else np.zeros((0, len(parts)), np.int64)
        self.component = np.repeat(np.arange(len(self.sampling)), [h * v for h, v in self.sampling])

    def scan_order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(block numbers in coding order, units of the scan in front of each image, blocks of a unit)."""
        if len(components) > 1:
            columns = np.isin(self.component, components)
            return self.order[:, columns].ravel(), self.units, int(columns.sum())
        k = components[0]
        first = self.first[k]
        if self.size is None:
            return np.arange(first[0], first[-1]), first - first[0], 1
        # Blocks outside the picture are no part of a scan of one component.
        h, v = self.sampling[k]
        across, down = (max(x) for x in zip(*self.sampling))
        rows = -(-(-(-self.size[:, 0] * v // down)) // 8)
        columns = -(-(-(-self.size[:, 1] * h // across)) // 8)
        of = np.concatenate([[0], np.cumsum(rows * columns)])
        image = np.repeat(np.arange(len(rows)), rows * columns)
        local = np.arange(of[-1]) - of[image]
        return first[image] + local // columns[image] * (self.width[image] * h) + local % columns[image], of, 1


def intervals(units: np.ndarray, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit of each restart interval and the end, number of intervals in front of each image)."""
    n = np.diff(units)
    each = -(-n // restart) if restart else (n > 0).astype(np.int64)
    number = np.concatenate([[0], np.cumsum(each)])
    image = np.repeat(np.arange(len(n)), each)
    start = units[image] + (np.arange(number[-1]) - number[image]) * (restart or 0)
    return np.append(start, units[-1]), number


def _pack(elements: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each lane, filled up with ones to whole bytes: (bytes, where each lane begins). An element is code * 64 + bits."""
    size = elements & 63
    code = (elements >> 6).astype(np.uint64)
    total = np.cumsum(size)
    last = np.searchsorted(lane, np.arange(lanes), side="right")
    ends = np.where(last > 0, total[last - 1], 0) if len(total) else np.zeros(lanes, np.int64)
    bits = np.diff(ends, prepend=0)
    octets = (bits + 7) >> 3
    start = np.concatenate([[0], np.cumsum(octets)])
    shift = start[:-1] * 8 - (ends - bits)
    at = total - size + shift[lane]
    word, room = at >> 6, 64 - (at & 63) - size
    over = np.maximum(-room, 0).astype(np.uint64)
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> over)
    out = np.zeros((int(start[-1]) >> 3) + 2, np.uint64)
    if len(word):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[heads]] = np.add.reduceat(high, heads)
        spill = np.flatnonzero(room < 0)
        out[word[spill] + 1] += code[spill] << (np.uint64(64) - over[spill])  # one element at most reaches over a word's end
    data = out.astype(">u8").view(np.uint8)[: int(start[-1])].copy()
    pad = (octets * 8 - bits).astype(np.int64)
    full = octets > 0
    data[start[1:][full] - 1] |= ((1 << pad[full]) - 1).astype(np.uint8)
    return data, start


def _entropy(elements: np.ndarray, lane: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each image: stuffed, with restart markers between its lanes."""
    lanes = int(number[-1])
    data, start = _pack(elements, lane, lanes)
    image = np.repeat(np.arange(len(number) - 1), np.diff(number))
    local = np.arange(lanes) - number[image]
    full = data == 255
    before = np.cumsum(full) - full
    marks = 2 * (np.arange(lanes) - image)  # bytes of markers in front of a lane: none before an image's first
    owner = np.repeat(np.arange(lanes), np.diff(start))
    place = np.arange(len(data)) + before + marks[owner]
    ends = (np.append(place, 0)[start[:-1]] if lanes else np.zeros(0, np.int64))
    out = np.zeros(len(data) + int(full.sum()) + (int(marks[-1]) if lanes else 0), np.uint8)
    out[place] = data
    inner = np.flatnonzero(local > 0)
    out[ends[inner] - 2] = 255
    out[ends[inner] - 1] = 0xD0 + (local[inner] - 1) % 8
    firsts = np.append(ends[number[:-1]], len(out))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]


def _with(main: np.ndarray, at: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``more`` put in front of the places ``at`` (ascending) of ``main``."""
    out = np.empty(len(main) + len(more), main.dtype)
    spot = at + np.arange(len(more))
    rest = np.ones(len(out), bool)
    rest[spot] = False
    out[spot], out[rest] = more, main
    return out


def _first_band(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, block) of a band's first scan; ``v`` (blocks, width) without the lowest bits."""
    width = v.shape[1]
    flat = v.ravel()
    hit = np.flatnonzero(flat)
    block, value = hit // width, flat[hit]
    before = np.concatenate([[-1], hit[:-1]])
    run = hit - np.maximum(before, block * width - 1) - 1
    size, bits = _magnitude(value)
    symbol = ((run & 15) << 4) | size
    main = ((AC_CODE.code[symbol] << size | bits) << 6) | (AC_CODE.size[symbol] + size)
    last = np.full(len(v), -1)
    last[block] = hit - block * width
    short = np.flatnonzero(last < width - 1)
    ends = np.full(len(short), AC_CODE.code[0] << 6 | AC_CODE.size[0])
    long = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
    skips = np.full(len(long), AC_CODE.code[0xF0] << 6 | AC_CODE.size[0xF0])
    # An end of block stands behind its block's values; a skip right before its value.
    at = np.concatenate([np.searchsorted(hit, (short + 1) * width), long])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return _with(main, at, np.concatenate([ends, skips])[order]), _with(block, at, np.concatenate([short, block[long]])[order])


def _refined_band(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, block) of the scan of the lowest bits."""
    width = v.shape[1]
    flat = np.abs(v).ravel()
    old = np.flatnonzero(flat > 1)
    main = ((flat[old].astype(np.int64) & 1) << 6) | 1
    new = np.flatnonzero(flat == 1)
    zero = np.flatnonzero(flat == 0)

    def opens(at: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Where the stretch of each event begins: behind the event before it in its block."""
        return np.maximum(np.concatenate([[-1], at[:-1]]) + 1, block * width)

    block = new // width
    zeros = np.searchsorted(zero, opens(new, block))  # zeros in front of the stretch
    run = np.searchsorted(zero, new) - zeros
    times = run >> 4
    owner = np.repeat(np.arange(len(new)), times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    skip = zero[zeros[owner] + 16 * (nth + 1) - 1]
    symbol = ((run & 15) << 4) | 1
    sign = (v.ravel()[new] > 0).astype(np.int64)
    codes = ((AC_CODE.code[symbol] << 1 | sign) << 6) | (AC_CODE.size[symbol] + 1)
    at = np.concatenate([skip, new])
    order = np.argsort(at, kind="stable")
    at = at[order]
    codes = np.concatenate([np.full(len(skip), AC_CODE.code[0xF0] << 6 | AC_CODE.size[0xF0]), codes])[order]
    blocks = at // width
    begin = opens(at, blocks)
    last = np.arange(len(v)) * width - 1
    last[blocks] = at  # the last one stays
    short = np.flatnonzero(last < (np.arange(len(v)) + 1) * width - 1)
    begin = np.concatenate([begin, last[short] + 1])
    codes = np.concatenate([codes, np.full(len(short), AC_CODE.code[0] << 6 | AC_CODE.size[0])])
    blocks = np.concatenate([blocks, short])
    order = np.argsort(begin, kind="stable")
    where = np.searchsorted(old, begin[order])
    return _with(main, where, codes[order]), _with(old // width, where, blocks[order])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


BANDS = ((1, 9), (10, 63))


def write(coefficients: np.ndarray, shape: Shape, comments: list[bytes]) -> list[bytes]:
    """Files of a run of images; ``coefficients`` (blocks, 64) in the order of the file, |value| < 1024."""
    c = coefficients.astype(np.int64)
    n = len(shape.width)
    everything = (0, 1, 2)
    scans: list[tuple[bytes, list[bytes]]] = []

    def add(components: tuple[int, ...], low: int, high: int, old: int, new: int, elements: np.ndarray, unit: np.ndarray, units: np.ndarray) -> None:
        start, number = intervals(units, RESTART)
        lane = np.searchsorted(start[:-1], unit, side="right") - 1
        head = bytes([len(components)]) + b"".join(bytes([k + 1, 0]) for k in components) + bytes([low, high, old << 4 | new])
        scans.append((_segment(DRI, struct.pack(">H", RESTART)) + _segment(SOS, head), _entropy(elements, lane, number)))

    order, units, per = shape.scan_order(everything)
    unit = np.arange(len(order)) // per
    dc = (c[order, 0] >> 1).reshape(-1, per)
    start, _ = intervals(units, RESTART)
    fresh = np.zeros(len(dc), bool)
    fresh[start[:-1]] = True
    diff = np.empty_like(dc)
    for k in everything:
        columns = np.flatnonzero(shape.component == k)
        chain = dc[:, columns]
        before = np.concatenate([np.zeros((len(dc), 1), np.int64), chain[:, :-1]], axis=1)
        before[1:, 0] = np.where(fresh[1:], 0, chain[:-1, -1])
        diff[:, columns] = chain - before
    size, bits = _magnitude(diff.ravel())
    add(everything, 0, 0, 0, 1, ((DC_CODE.code[size] << size | bits) << 6) | (DC_CODE.size[size] + size), unit, units)
    for k in everything:
        own, of, _ = shape.scan_order((k,))
        for low, high in BANDS:
            v = c[own, low : high + 1]
            elements, block = _first_band(np.sign(v) * (np.abs(v) >> 1))
            add((k,), low, high, 0, 1, elements, block, of)
    add(everything, 0, 0, 1, 0, ((c[order, 0] & 1) << 6) | 1, unit, units)
    for k in everything:
        own, of, _ = shape.scan_order((k,))
        elements, block = _refined_band(c[own, 1:64])
        add((k,), 1, 63, 1, 0, elements, block, of)
    tables = _segment(DQT, bytes([0]) + bytes([1] * 64)) + _segment(DHT, DC_CODE.segment(0x00)) + _segment(DHT, AC_CODE.segment(0x10))
    files = []
    for k in range(n):
        frame = struct.pack(">BHHB", 8, int(shape.height[k]) * 16, int(shape.width[k]) * 16, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(shape.sampling))
        files.append(b"".join([bytes([255, SOI]), _segment(COM, comments[k]), tables, _segment(SOF2, frame), *(x for head, data in scans for x in (head, data[k])), bytes([255, EOI])]))
    return files


@dataclass
class Scan:
    components: tuple[int, ...]
    low: int
    high: int
    old: int
    new: int
    restart: int
    dc: tuple[bytes, ...]  # the tables of the scan's components
    ac: tuple[bytes, ...]
    start: int = 0
    end: int = 0

    def kind(self) -> tuple:
        return (self.components, self.low, self.high, self.old, self.new, self.restart, self.dc, self.ac)


@dataclass
class Parsed:
    size: tuple[int, int] = (0, 0)  # height, width
    sampling: tuple[tuple[int, int], ...] = ()
    quantisers: tuple[bytes, ...] = ()
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)

    def kind(self) -> tuple:
        return (self.sampling, self.quantisers, tuple(s.kind() for s in self.scans))


def parse(data: bytes) -> Parsed:
    """Headers of a progressive file and where its scans' data stand."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, restart = Parsed(), 2, 0
    tables: dict[int, bytes] = {}
    quantisers: dict[int, bytes] = {}
    ids: list[int] = []
    uses: list[int] = []
    while True:
        while data[at + 1] == 255:
            at += 1
        if data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == EOI:
            break
        body = data[at + 4 : at + 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]]
        at += 4 + len(body)
        if marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == DQT:
            while body:
                n = 65 if body[0] < 16 else 129
                wide = body[1:n] if n == 129 else bytes(x for v in body[1:n] for x in (0, v))
                quantisers[body[0] & 15], body = wide, body[n:]
        elif marker == SOF2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            out.size = (height, width)
            ids = [body[6 + 3 * k] for k in range(n)]
            out.sampling = tuple((body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n))
            uses = [body[8 + 3 * k] for k in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive files are read")
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == COM:
            out.comment = body
        elif marker == SOS:
            n = body[0]
            picks = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            low, high, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _NEXT_MARKER.search(data, at)
            if not end:
                raise ValueError("the file ends in a scan")
            dc = tuple(tables.get(t >> 4, b"") for _, t in picks) if not low and not bits >> 4 else ()
            ac = tuple(tables.get(16 + (t & 15), b"") for _, t in picks) if low else ()
            out.scans.append(Scan(tuple(k for k, _ in picks), low, high, bits >> 4, bits & 15, restart, dc, ac, at, end.start()))
            at = end.start()
    out.quantisers = tuple(quantisers[k] for k in uses)
    if not out.scans or not out.sampling or min(out.size) < 1 or min(min(x) for x in out.sampling) < 1 or len(out.sampling) not in (1, 3):
        raise ValueError("the file has no picture that is read")
    if out.size[0] * out.size[1] > MOST_PIXELS:
        raise ValueError("the picture is too large")
    return out


_CODES: dict[bytes, Code] = {}


def _code_of(table: bytes) -> Code:
    if table not in _CODES:
        if len(_CODES) > 64:
            _CODES.clear()
        _CODES[table] = Code(table[:16], table[16:])
    return _CODES[table]


@dataclass
class Bits:
    """Data of one scan of many files without stuffing; each lane begins at a whole byte."""

    words: np.ndarray  # 64 bits from each byte on
    lane: np.ndarray  # first bit of each lane

    @classmethod
    def of(cls, parts: list[bytes], number: np.ndarray) -> Bits:
        sizes = np.cumsum([0] + [len(p) for p in parts])
        data = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
        after = np.append(data[1:], 0)
        mark = (data == 255) & (after >= 0xD0) & (after <= 0xD7)
        skip = mark.copy()
        skip[1:] |= mark[:-1] | ((data[:-1] == 255) & (data[1:] == 0))
        kept = np.concatenate([[0], np.cumsum(~skip)])
        heads = np.sort(np.concatenate([sizes[:-1][np.diff(number) > 0], np.flatnonzero(mark) + 2]))
        if len(heads) != number[-1]:
            raise ValueError("restart markers do not fit the restart interval")
        pure = np.concatenate([data[~skip], np.zeros(8, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(pure, 8)
        return cls(np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64), kept[heads] * 8)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next bits, from the highest of 64 on; 57 at least."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.window(at) >> np.uint64(63)).astype(np.int64)


_48 = np.uint64(48)


def _value(window: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number in the ``size`` bits behind the ``used`` first ones."""
    raw = ((window << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw) * (size > 0)


def _read_dc(c: np.ndarray, shape: Shape, scan: Scan, bits: Bits, order: np.ndarray, start: np.ndarray, per: int) -> None:
    columns = np.flatnonzero(np.isin(shape.component, scan.components)) if per > 1 else np.zeros(1, np.int64)
    component = shape.component[columns] if per > 1 else np.array(scan.components)
    slots = [scan.components.index(int(k)) for k in component]
    lookup = [_code_of(t).lookup for t in scan.dc]
    at, unit, end = bits.lane.copy(), start[:-1].copy(), start[1:]
    held = np.zeros((len(scan.components), len(at)), np.int64)
    alive = np.flatnonzero(unit < end)
    while len(alive):
        a, u = at[alive], unit[alive]
        for k, slot in enumerate(slots):
            w = bits.window(a)
            e = lookup[slot][(w >> _48).astype(np.int64)].astype(np.int64)
            length, size = e >> 8, e & 255
            held[slot, alive] += _value(w, length, size)
            c[order[u * per + k], 0] = held[slot, alive] << scan.new
            a = a + length + size
        at[alive] = a
        unit[alive] += 1
        alive = alive[unit[alive] < end[alive]]


def _read_band(c: np.ndarray, scan: Scan, bits: Bits, order: np.ndarray, start: np.ndarray) -> None:
    """A band's first scan: one symbol in each lane at a step."""
    lookup = _code_of(scan.ac[0]).lookup
    flat = c.reshape(-1)
    at, block, end = bits.lane.copy(), start[:-1].copy(), start[1:].copy()
    k = np.full(len(at), scan.low)
    while len(at):
        w = bits.window(at)
        e = lookup[(w >> _48).astype(np.int64)].astype(np.int64)
        length, symbol = e >> 8, e & 255
        run, size = symbol >> 4, symbol & 15
        value = _value(w, length, size)
        hit = size > 0
        k += run
        flat[(order[block] * 64 + np.minimum(k, 63))[hit]] = value[hit] << scan.new
        at += length + size
        k += 1
        if not hit.all():
            over = np.flatnonzero(~hit & (run < 15))
            r = run[over]
            more = ((w[over] << length[over].astype(np.uint64)) >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64)
            at[over] += r
            block[over] += (1 << r) + more  # a run of blocks without more values in the band
            k[over] = scan.low
        full = k > scan.high
        block += full
        k[full] = scan.low
        if (block >= end).any():
            alive = block < end
            at, block, end, k = at[alive], block[alive], end[alive], k[alive]


def _read_refined(c: np.ndarray, scan: Scan, bits: Bits, order: np.ndarray, start: np.ndarray) -> None:
    """A band's lower bit: new values by symbol, then all corrections at once."""
    lookup = _code_of(scan.ac[0]).lookup
    low, width, n = scan.low, scan.high - scan.low + 1, len(order)
    band = c[order, low : scan.high + 1].astype(np.int64)
    old = (band != 0).ravel()
    zero = np.flatnonzero(~old)
    zeros = np.concatenate([[0], np.cumsum(~old)])  # zeros in front of each place
    fresh = np.zeros(n * width, np.int64)
    at, place, end = bits.lane.copy(), start[:-1] * width, start[1:] * width
    empty = np.zeros(len(at), np.int64)  # blocks left of a run of blocks without new values
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (from, to, first bit)
    alive = place < end
    at, place, end, empty = at[alive], place[alive], end[alive], empty[alive]
    while len(at):
        w = bits.window(at)
        e = lookup[(w >> _48).astype(np.int64)].astype(np.int64)
        length, symbol = e >> 8, e & 255
        run, size = symbol >> 4, symbol & 15
        running = empty > 0
        over = ~running & (size == 0) & (run < 15)
        r = np.where(over, run, 0)
        more = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64)
        sign = ((w << length.astype(np.uint64)) >> np.uint64(63)).astype(np.int64)
        empty = np.where(over, (1 << r) + more, empty)
        closing = over | running
        at = at + np.where(running, 0, length + np.where(over, r, size > 0))
        stop = (place // width + 1) * width
        target = zero[np.minimum(zeros[place] + run, len(zero) - 1)] if len(zero) else stop - 1
        until = np.where(closing, stop, np.minimum(target, stop - 1) + 1)  # behind what this symbol covers
        hit = ~closing & (size > 0)
        fresh[target[hit]] = np.where(sign[hit] > 0, 1, -1)
        spans.append((place, until, at))
        at = at + (until - place) - (zeros[until] - zeros[place])  # a bit for each old value passed
        empty = empty - closing
        place = until
        if (place >= end).any():
            alive = place < end
            at, place, end, empty = at[alive], place[alive], end[alive], empty[alive]
    if not spans:
        return
    begin, until, first = (np.concatenate(x) for x in zip(*spans))
    by = np.argsort(begin, kind="stable")
    begin, until, first = begin[by], until[by], first[by]
    olds = np.arange(n * width) - zeros[:-1]
    spot = np.repeat(first - olds[begin], until - begin) + olds
    flat = band.ravel()
    which = np.flatnonzero(old)
    flat[which] += (bits.bit(spot[which]) << scan.new) * np.sign(flat[which])
    flat += fresh << scan.new
    c[order, low : scan.high + 1] = flat.reshape(n, width)


#: What broken files make the readers raise.
BROKEN = (ValueError, IndexError, KeyError, struct.error, MemoryError, OverflowError)
#: Pixels of a picture, at most: headers may promise any size.
MOST_PIXELS = 1 << 28


class Group(NamedTuple):
    """Files with the same scans, read together."""

    members: list[int]  # their places in the files given
    shape: Shape
    coefficients: np.ndarray  # (blocks, 64)
    heads: list[Parsed]


def read(files: list[bytes]) -> tuple[list[Group], dict[int, str]]:
    """The files in groups, and why which of them could not be read, by place."""
    parsed: dict[int, Parsed] = {}
    failed: dict[int, str] = {}
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(files):
        try:
            parsed[k] = parse(f)
            groups.setdefault(parsed[k].kind(), []).append(k)
        except BROKEN as e:
            failed[k] = str(e) or type(e).__name__
    out = []
    todo = list(groups.values())
    while todo:
        members = todo.pop(0)
        try:
            out.append(_decoded(files, members, [parsed[k] for k in members]))
        except BROKEN as e:
            if len(members) > 1:
                todo += [[k] for k in members]
            else:
                failed[members[0]] = str(e) or type(e).__name__
    return out, failed


def _decoded(files: list[bytes], members: list[int], heads: list[Parsed]) -> Group:
    sizes = np.array([p.size for p in heads])
    across, down = (max(x) for x in zip(*heads[0].sampling))
    units = -(-sizes // (8 * down, 8 * across))
    whole = (sizes == units * (8 * down, 8 * across)).all()
    shape = Shape(units[:, 1], units[:, 0], heads[0].sampling, None if whole else sizes)
    c = np.zeros((shape.blocks, 64), np.int16)
    for s, scan in enumerate(heads[0].scans):
        order, count, per = shape.scan_order(scan.components)
        start, number = intervals(count, scan.restart)
        bits = Bits.of([files[k][p.scans[s].start : p.scans[s].end] for k, p in zip(members, heads)], number)
        if scan.low == 0 and scan.old == 0:
            _read_dc(c, shape, scan, bits, order, start, per)
        elif scan.low == 0:
            unit = np.arange(len(order)) // per
            lane = np.searchsorted(start[:-1], unit, side="right") - 1
            c[order, 0] |= (bits.bit(bits.lane[lane] + np.arange(len(order)) - start[lane] * per) << scan.new).astype(np.int16)
        elif scan.old == 0:
            _read_band(c, scan, bits, order, start)
        else:
            _read_refined(c, scan, bits, order, start)
    return Group(members, shape, c, heads)


_IDCT = idct_matrix()


def rgb_units(c: np.ndarray, shape: Shape, heads: list[Parsed]) -> np.ndarray:
    """(units, height, width, 3) bytes: colours of each unit, chroma upsampled by repetition."""
    h, v = (max(x) for x in zip(*shape.sampling))
    quantisers = heads[0].quantisers  # of all: they are part of what files are grouped by
    planes = []
    for k, (a, b) in enumerate(shape.sampling):
        q = np.frombuffer(quantisers[k], ">u2").astype(np.float32)
        blocks = shape.order[:, shape.component == k].ravel()
        x = (c[blocks].astype(np.float32) * q) @ _IDCT
        x *= np.float32(1 / 4096)
        x += np.float32(128)
        np.rint(x, out=x)
        np.clip(x, 0, 255, out=x)
        x = x.reshape(-1, b, a, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * b, 8 * a)
        planes.append(x.repeat(v // b, axis=1).repeat(h // a, axis=2) if (a, b) != (h, v) else x)
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=3)
    y, cb, cr = planes
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.rint(x, out=x)
        np.clip(x, 0, 255, out=x)
        out[..., k] = x
    return out


def image(units: np.ndarray, width: int, height: int, size: tuple[int, int] | None = None) -> np.ndarray:
    """(rows, columns, 3) of one image from its units; what lies beyond its size is cut off."""
    n, b, a, _ = units.shape
    whole = units.reshape(height, width, b, a, 3).transpose(0, 2, 1, 3, 4).reshape(height * b, width * a, 3)
    return whole if size is None else whole[: size[0], : size[1]]
