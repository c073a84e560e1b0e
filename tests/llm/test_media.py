import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import gif


def classic(samples: bytes, root: int = 8, clear_at: int | None = None) -> bytes:
    """A plain encoder with full dictionaries, clears and any sample size, to hold the decoder against."""

    clear = 1 << root
    known = {bytes([i]): i for i in range(clear)}
    free, n = clear + 2, 0
    out = []

    def emit(code):
        nonlocal n
        entries = clear + 2 + max(n - 1, 0)
        w = min(12, min(entries, 4095).bit_length())
        out.append((code, w))
        n += 1

    out.append((clear, root + 1))
    w = b""
    for i, b in enumerate(samples):
        c = w + bytes([b])
        if c in known:
            w = c
            continue
        emit(known[w])
        if free < 4096:
            known[c] = free
            free += 1
        w = bytes([b])
        if clear_at and i % clear_at == 0:
            emit(clear)
            known = {bytes([i]): i for i in range(clear)}
            free, n = clear + 2, 0
    if w:
        emit(known[w])
    emit(clear + 1)
    value = at = 0
    for code, size in out:
        value |= code << at
        at += size
    return value.to_bytes((at + 7) // 8, "little")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(8, 256), (8, 2), (8, 7), (2, 4), (4, 16)]), st.sampled_from([1, 50, 3000, 20_000]), st.sampled_from([None, 97, 5000]))
def test_decoder_reads_what_others_write(seed, kind, n, clear_at):
    root, top = kind
    s = np.random.default_rng(seed).integers(0, top, n, dtype=np.uint8).tobytes()
    assert gif.lzw_decode(classic(s, root, clear_at), root, n) == s


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 256), st.integers(0, 99)), min_size=1, max_size=6))
def test_round_trip(kinds):
    every = [np.random.default_rng(s).integers(0, top, 576 * n, dtype=np.uint8).tobytes() for n, top, s in kinds]
    for s, m in zip(every, gif.gif_encode(every), strict=True):
        assert b"".join(f.own()[..., 0].tobytes() for f in gif.gif_decode(m)) == s


def image(frames, size=(2, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(v for c in palette for v in c)
    for x, y, w, h, indices, disposal, through, delay, flags in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (through is not None), delay, through or 0, 0)
        data = classic(bytes(indices), 2)
        out += struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + b"\x02" + bytes([len(data)]) + data + b"\x00"
    return out + b"\x3b"


def reds(f):
    return [["." if not p[3] else "kRGB"[[(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)].index(tuple(int(v) for v in p[:3]))] for p in row] for row in f.canvas]


def test_disposal_and_transparency():
    full = (0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, 0)
    got = [*gif.gif_decode(image([full, (0, 0, 1, 1, [2], 2, None, 7, 0), (1, 1, 1, 1, [3], 3, None, 1, 0), (0, 0, 2, 1, [0, 3], 0, 0, 2, 0)]))]
    assert [f.delay for f in got] == [5, 7, 1, 2]
    assert reds(got[0]) == [["R", "R"], ["R", "R"]]
    assert reds(got[1]) == [["G", "R"], ["R", "R"]]
    assert reds(got[2]) == [[".", "R"], ["R", "B"]]  # the frame before was cleared
    assert reds(got[3]) == [[".", "B"], ["R", "R"]]  # that one was taken back; index 0 is transparent


def test_interlace():
    got = next(gif.gif_decode(image([(0, 0, 1, 4, [0, 1, 2, 3], 0, None, 0, 0x40)], (1, 4))))
    assert [r[0] for r in reds(got)] == ["k", "G", "R", "B"]


def test_damage():
    good = gif.gif_encode([b"abc" * 192])[0]
    for bad in (b"", b"GIF89a", good[:830], good[:-40], b"x" + good):
        with pytest.raises(ValueError):
            [*gif.gif_decode(bad)]
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([0x00, 0xFE, 0x03]), 8, 50)


def test_frames_table(spark):
    media = spark.createDataFrame([(1, bytearray(image([(0, 0, 2, 2, [1, 2, 3, 0], 1, None, 5, 0)] * 2))), (2, None), (3, bytearray(b"GIF89a"))], "id long, media binary")
    rows = gif.frames(media, "id").collect()
    good = [r for r in rows if r["error"] is None]
    assert [(r["id"], r["frame"], r["begin_cs"], r["delay_cs"]) for r in good] == [(1, 0, 0, 5), (1, 1, 5, 5)]
    assert good[0]["hist_red"][15] == 1 and sum(good[0]["hist_blue"]) == 4
    assert [r["id"] for r in rows if r["error"]] == [3]


def test_texts(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "long " * 20_000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in gif.digests(gif.encode_texts(docs)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2]["media_sha256"] == got[6]["media_sha256"] and got[2]["feature"] == got[6]["feature"]
    assert gif.digests(gif.encode_texts(docs.limit(0))).count() == 0
