from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from gridloom.llm import jpeg, media

RNG = np.random.default_rng(0)
KINDS = {
    "any": lambda s: RNG.integers(-128, 128, s),
    "sparse": lambda s: RNG.integers(-128, 128, s) * (RNG.random(s) < 0.03),
    "ones": lambda s: RNG.integers(-1, 2, s),
    "few ones": lambda s: (RNG.random(s) < 0.02) * RNG.integers(-1, 2, s) + (RNG.random(s) < 0.1) * 5,
    "none": lambda s: np.zeros(s),
}


@pytest.mark.parametrize("kind", KINDS)
def test_coefficients_come_back(kind):
    shape = jpeg.Shape(np.array([1, 3, 5, 1]), np.array([1, 2, 5, 7]))
    c = KINDS[kind]((shape.blocks, 64)).astype(np.int16)
    files = jpeg.write(c, shape, [b""] * 4)
    [(members, _, back, _)], failed = jpeg.read(files)
    assert members == [0, 1, 2, 3] and not failed and (back == c).all()
    for k in range(4):  # alone as in company
        [(_, alone, own, _)], _ = jpeg.read([files[k]])
        assert all((own[alone.first[i][0] : alone.first[i][1]] == c[shape.first[i][k] : shape.first[i][k + 1]]).all() for i in range(3))


def test_the_jvms_reader_sees_the_same_picture(spark, tmp_path):
    """Grey pictures, as readers upsample chroma in different ways."""
    shape = jpeg.Shape(np.array([3]), np.array([2]))
    c = np.zeros((shape.blocks, 64), np.int16)
    grey = c[: shape.first[0][1]]
    grey[:] = RNG.integers(-12, 13, grey.shape) * (RNG.random(grey.shape) < 0.5)
    [data] = jpeg.write(c, shape, [b"x"])
    (tmp_path / "x.jpg").write_bytes(data)
    [(_, _, back, heads)], _ = jpeg.read([data])
    mine = jpeg.image(jpeg.rgb_units(back, shape, heads), 3, 2).astype(int)
    jvm = spark._jvm
    other = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "x.jpg")))
    assert (other.getHeight(), other.getWidth()) == mine.shape[:2]
    for y in range(0, 32, 5):
        for x in range(0, 48, 5):
            assert abs((other.getRGB(x, y) & 255) - mine[y, x, 2]) <= 2


def test_runs_of_empty_blocks_from_elsewhere():
    """A band's scan that says in one symbol that several blocks have nothing more."""
    shape = jpeg.Shape(np.array([1]), np.array([1]))
    c = np.zeros((shape.blocks, 64), np.int16)
    c[1, 3] = 6
    [data] = jpeg.write(c, shape, [b""])
    scan = jpeg.parse(data).scans[1]
    assert (scan.components, scan.low, scan.high) == ((0,), 1, 9)
    code = jpeg.AC_CODE
    # Block 0: nothing; block 1: run 2, size 2, value 3, nothing more; blocks 1-3 end in a run of two more blocks.
    symbols = [(0, None), (0x22, (3, 2)), (0x10, (1, 1))]
    bits = ""
    for s, extra in symbols:
        bits += format(code.code[s], f"0{code.size[s]}b") + (format(extra[0], f"0{extra[1]}b") if extra else "")
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    [(_, _, back, _)], _ = jpeg.read([data[: scan.start] + body + data[scan.end :]])
    assert (back == c).all()


@pytest.mark.parametrize("data", [b"", b"a", b"\x80" * 5000, bytes(range(256)) * 9, b"\xff" * 777, "ÀÀ\x80é‐".encode() * 400, b"\x7f\x81" * 900])
def test_payloads(data):
    [file] = media.encode([data])
    [(back, rgb)] = media.decode([file])
    assert back == data and rgb.dtype == np.uint8 and rgb.shape[0] % 16 == rgb.shape[1] % 16 == 0


def test_what_is_not_read():
    with pytest.raises(ValueError):
        jpeg.parse(b"no")
    [file] = media.encode([b"x" * 300])
    with pytest.raises(ValueError):
        jpeg.parse(file.replace(b"\xff\xc2", b"\xff\xc0", 1))


ROWS = [(1, "abc", 7), (1, "abc", 7), (None, None, 8), (2, "", 9), (3, "é" * 576, 1), (4, "x" * 250_000, 2)]


def test_texts(spark):
    rows = media.text_media(spark.createDataFrame(ROWS, "doc_id long, text string, feature int")).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[2]
    for i, text, _ in ROWS:
        data = (text or "").encode()
        filled = data + b"\xff" * (-len(data) % 576 if data else 576)
        [(n, size, digest, crc, media_bytes, media_sha, feature, height, width, rgb_sha)] = by[i]
        assert (n, size, digest, crc) == (len(data), len(filled), hashlib.sha256(filled).hexdigest(), zlib.crc32(filled[-32:]))
        [file] = media.encode([filled])
        [(back, rgb)] = media.decode([file])
        assert (media_bytes, media_sha, back) == (len(file), hashlib.sha256(file).hexdigest(), filled)
        assert (height, width) == rgb.shape[:2] and rgb_sha == hashlib.sha256(rgb.tobytes()).hexdigest()
        means = ",".join(f"{rgb[..., k].sum(dtype=int) / (height * width):.3f}" for k in range(3))
        assert feature == f"{height}x{width}:{means}"


def colours(spark, tmp_path, data):
    """What the JVM's reader makes of a file."""
    (tmp_path / "x.jpg").write_bytes(data)
    jvm = spark._jvm
    other = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "x.jpg")))
    raster = np.array(list(other.getRGB(0, 0, other.getWidth(), other.getHeight(), None, 0, other.getWidth()))).reshape(other.getHeight(), other.getWidth())
    return np.stack([raster >> 16 & 255, raster >> 8 & 255, raster & 255], -1)


@pytest.mark.parametrize("cut", [(0, 0), (5, 11), (15, 1), (8, 8)])
def test_the_jvms_reader_sees_the_same_colours(spark, tmp_path, cut):
    """Chroma included, over any size: each chroma plane is one value, as readers upsample edges in different ways."""
    rng = np.random.default_rng(3)
    shape = jpeg.Shape(np.array([3]), np.array([2]))
    for _ in range(4):
        c = np.zeros((shape.blocks, 64), np.int16)
        grey = c[: shape.first[0][1]]
        grey[:] = rng.integers(-9, 10, grey.shape) * (rng.random(grey.shape) < 0.4)
        grey[:, 0] = rng.integers(-300, 300, len(grey))
        for k in (1, 2):
            c[shape.first[k][0] : shape.first[k][1], 0] = rng.integers(-400, 400)
        data = resized(jpeg.write(c, shape, [b"x"])[0], 32 - cut[0], 48 - cut[1], c, shape)
        row = media.from_media(spark.createDataFrame([(1, bytearray(data))], "id long, media binary")).first()
        mine = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3).astype(int)
        other = colours(spark, tmp_path, data)
        assert mine.shape == other.shape == (32 - cut[0], 48 - cut[1], 3) and np.abs(mine - other).max() <= 3


def resized(data, rows, columns, c, shape):
    """The file for a picture that ends inside its units: scans of one component lose the blocks outside."""
    if (rows, columns) == (32, 48):
        return data
    small = jpeg.Shape(shape.width, shape.height, shape.sampling, np.array([[rows, columns]]))
    [file] = jpeg.write(c, small, [b"x"])
    at = file.index(b"\xff\xc2") + 5
    return file[:at] + rows.to_bytes(2, "big") + columns.to_bytes(2, "big") + file[at + 4 :]


def test_broken_files_have_reasons(spark):
    [good] = media.encode([b"payload " * 90])
    files = {1: good, 2: b"rubbish", 3: b"\xff\xd8", 4: good[: len(good) // 2], 5: good.replace(b"\xff\xc2", b"\xff\xc0", 1), 6: b"", 7: None, 8: good[:-40] + good[-2:], 9: good}
    rows = {r.id: r for r in media.from_media(spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in files.items()], "id long, media binary")).collect()}
    assert all(rows[k].rgb and rows[k].error is None for k in (1, 9))
    assert all(rows[k].rgb is None and rows[k].error for k in (2, 3, 4, 5, 6)) and rows[7].rgb is None and rows[7].error is None


def test_random_damage_ends_no_job():
    rng = np.random.default_rng(8)
    [good] = media.encode([bytes(rng.integers(32, 120, 3000).astype(np.uint8))])
    files = []
    for _ in range(120):
        data = bytearray(good)
        for at in rng.integers(0, len(data), 4):
            data[at] = rng.integers(256)
        files.append(bytes(data))
    groups, failed = jpeg.read([good, *files, good])
    assert {k for g in groups for k in g.members} | set(failed) == set(range(122)) and {0, 121} <= {k for g in groups for k in g.members}


def test_columns_of_media(spark):
    df = spark.createDataFrame([(1, bytearray(b"hello" * 50)), (2, None), (3, bytearray())], "id long, payload binary")
    files = media.to_media(df)
    assert {r.id: r.media is None for r in files.collect()} == {1: False, 2: True, 3: False}
    tensors = {r.id: r for r in media.from_media(files).collect()}
    assert tensors[2].rgb is None and len(tensors[1].rgb) == tensors[1].height * tensors[1].width * 3
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []
