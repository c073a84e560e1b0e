"""Media columns: GIF encoding, decoding and colour-histogram frames.

``encode`` lays bytes out as 8-bit palette indices in frames of one animation, compressed with variable-width
LZW. ``decode`` reads any GIF 87a or 89a: global and local palettes, interlacing, transparency, the disposal
rules, delays, and code streams with clears at any place. Code positions follow from the number of codes since
the last clear alone, so all codes of a stretch are unpacked at once; only the dictionary is built code by code.

``frames`` gives a row for each frame of a media column: number, begin and length in hundredths of a second,
size, pixels and a histogram of each colour channel.

Defined cases: null or empty bytes encode as no samples, for payloads of text padded to one row; null media
decode to no frames; damaged media give the frames before the damage and say what was wrong in ``error``;
equal bytes give equal media; repeated rows are each kept; texts of any length are stored whole, as many frames;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_of

WIDTH = 576
#: Rows of a frame; more samples give more frames.
ROWS = 6
DELAY = 4
CLEAR, STOP, FIRST, FULL = 256, 257, 258, 4096
#: Samples that cannot fill a dictionary, streams encoded together, and slots of a stream's table.
LONGEST, STREAMS, SLOTS = FULL - FIRST, 1536, 4096
#: Histogram bins of a channel.
BINS = 16
PADDING = 255
#: Rows handled together.
PART, PART_BYTES = 1024, 4 << 20

#: The lowest bits, by their number.
MASKS = ((1 << np.arange(13)) - 1).astype(np.int32)

_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def code_widths(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the first ``n`` codes after a clear, and the bit each begins at; ``root`` bits a sample."""
    have = _WIDTHS.get(root)
    if have is None or len(have[0]) < n:
        entries = np.minimum((1 << root) + 2 + np.maximum(np.arange(max(n, 8192)) - 1, 0), FULL - 1)
        bits = np.frexp(entries.astype(np.float64))[1].astype(np.int64)
        _WIDTHS[root] = have = bits, np.concatenate([[0], np.cumsum(bits)])
    return have[0][:n], have[1][: n + 1]


def lzw_encode(streams: list[bytes]) -> list[bytes]:
    """A code stream in sub-blocks for each of ``streams``, with the byte that gives the sample size first.

    All streams advance by one sample at a time. A stream's dictionary is a hashed table of its own, one probe
    wide: where two strings meet in a slot the later one stays and the earlier is no longer found, which only
    ends a match early. Streams are too short to fill a dictionary.
    """
    if any(len(x) > LONGEST for x in streams):
        raise ValueError(f"a frame has more than {LONGEST} samples")
    order = sorted((i for i, x in enumerate(streams) if x), key=lambda i: -len(streams[i]))
    out = [b"\x08" + _packed_blocks(b"\x01\x03")] * len(streams)  # clear and stop alone: nine bits each
    for at in range(0, len(order), STREAMS):
        part = order[at : at + STREAMS]
        for i, packed in zip(part, _lzw_together([streams[i] for i in part]), strict=True):
            out[i] = b"\x08" + _packed_blocks(packed)
    return out


def _packed_blocks(data: bytes) -> bytes:
    return b"".join([x for i in range(0, len(data), 255) for x in (bytes([len(data[i : i + 255])]), data[i : i + 255])]) + b"\x00"


def _lzw_together(streams: list[bytes]) -> list[bytes]:
    """Packed codes of ``streams``, which are sorted by length, longest first."""
    lengths = np.array([len(x) for x in streams])
    n, steps = len(streams), int(lengths[0])
    samples = np.zeros((n, steps), np.uint8)
    samples[np.arange(steps) < lengths[:, None]] = np.frombuffer(b"".join(streams), np.uint8)
    samples = np.ascontiguousarray(samples.T).astype(np.uint32)
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    base = np.arange(n, dtype=np.uint32) * SLOTS
    table = np.full(n * SLOTS, 0xFFFFFFFF, np.uint32)  # string of 20 bits, code of 12
    codes = np.full((steps + 1, n), -1, np.int16)
    w, free = samples[0].copy(), np.full(n, FIRST, np.uint32)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    for t in range(1, steps):
        k = active[t]
        own, b = w[:k], samples[t, :k]
        key = (own << np.uint32(8)) | b
        slot = base[:k] + ((key * np.uint32(2654435761)) >> shift)
        held = table[slot]
        hit = (held >> np.uint32(12)) == key
        miss = ~hit
        np.copyto(codes[t, :k], own, where=miss, casting="unsafe")
        table[slot] = np.where(hit, held, (key << np.uint32(12)) | free[:k])
        free[:k] += miss
        w[:k] = np.where(hit, held & np.uint32(4095), b)
    codes[lengths, np.arange(n)] = w
    codes = codes.T
    kept = codes >= 0
    count = kept.sum(axis=1)
    # clear, codes, stop
    place = np.repeat(np.cumsum(count + 2) - count - 2, count) + 1 + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    every = np.full(int(count.sum()) + 2 * n, CLEAR, np.int32)
    every[place] = codes[kept]
    every[np.cumsum(count + 2) - 1] = STOP
    _, begin = code_widths(8, int(count.max()) + 1)
    local = np.arange(len(every)) - np.repeat(np.cumsum(count + 2) - count - 2, count + 2)
    bit = np.where(local == 0, 0, begin[np.maximum(local - 1, 0)] + 9)
    size = (begin[count + 1] + 9 + 7) // 8
    first = np.cumsum(size) - size
    at = np.repeat(first, count + 2) + (bit >> 3)
    shifted = every << (bit & 7).astype(np.int32)
    packed = sum(np.bincount(at + j, (shifted >> 8 * j) & 255, int(size.sum()) + 3) for j in range(3)).astype(np.uint8).tobytes()
    return [packed[a : a + m] for a, m in zip(first.tolist(), size.tolist(), strict=True)]


def lzw_decode(data: bytes, root: int, want: int) -> bytes:
    """Samples of a joined code stream, at most ``want``; raises on codes that no dictionary has."""
    clear, stop = 1 << root, (1 << root) + 1
    raw = np.frombuffer(data + b"\x00\x00\x00", np.uint8).astype(np.int32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out, have = 8 * len(data), 0, [], 0
    while have < want:
        n = min((total - at) // (root + 1), want - have + 2) + 1
        bits, begin = code_widths(root, n)
        n = int(np.searchsorted(begin[1:], total - at, "right"))
        if n <= 0:
            break
        place = begin[:n] + at
        codes = (window[place >> 3] >> (place & 7).astype(np.int32)) & MASKS[bits[:n]]
        special = np.flatnonzero((codes == clear) | (codes == stop))
        if len(special):
            n = int(special[0])
            at += int(begin[n + 1])
        else:
            at += int(begin[n])
        if n:
            part = _expand(codes[:n], clear + 2)
            out.append(part)
            have += len(part)
        if not len(special) or codes[n] == stop:
            break
    return b"".join(out)[:want]


def _expand(codes: np.ndarray, first: int) -> bytes:
    """Samples of the codes between two clears.

    The string that code ``first + k`` stands for is what the stream holds from the begin of its k-th code on,
    one sample longer than that code. So each sample is a copy of an earlier one, and following the copies to
    their origin for all samples at once, doubling the steps, needs no dictionary.
    """
    n = len(codes)
    k = codes - np.int32(first)
    made = k >= 0
    if (k >= np.minimum(np.arange(n, dtype=np.int32), FULL - first)).any() and (k >= np.minimum(np.arange(n), FULL - first))[made].any():
        raise ValueError("a code beyond the dictionary")
    up = np.empty(n + 1, np.int32)
    np.copyto(up[:n], np.where(made, k, n))
    up[n] = n
    more = np.zeros(n + 1, np.int32)
    more[:n] = made
    while up.min() < n:
        more += more[up]
        up = up[up]
    length = more[:n] + 1
    end = np.cumsum(length, dtype=np.int32)
    begin, size = end - length, int(end[-1])
    origin = np.arange(size, dtype=np.int32)
    origin += np.repeat(np.where(made, begin[np.maximum(k, 0)] - begin, np.int32(0)), length)
    while True:
        further = origin[origin]
        if np.array_equal(further, origin):
            break
        origin = further
    values = np.zeros(size, np.uint8)
    values[begin[~made]] = codes[~made]
    return values[origin].tobytes()


def gif_encode(every: list[bytes], width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> list[bytes]:
    """For each of ``every``, an animation whose frames hold its samples (a positive multiple of ``width``)
    under a grey palette."""
    if any(not x or len(x) % width for x in every):
        raise ValueError("samples must fill rows")
    step = width * rows
    cut = [[x[i : i + step] for i in range(0, len(x), step)] for x in every]
    coded = iter(lzw_encode([f for x in cut for f in x]))
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = []
    for x in cut:
        parts = [b"GIF89a", struct.pack("<HHBBB", width, len(x[0]) // width, 0xF7, 0, 0), grey]
        for f in x:
            parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(f) // width, 0), next(coded)]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    delay: int
    disposal: int
    indices: np.ndarray
    canvas: np.ndarray  # RGBA, after this frame was drawn

    def own(self) -> np.ndarray:
        """The part of the canvas that the frame covers."""
        return self.canvas[self.y : self.y + self.height, self.x : self.x + self.width]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        if len(parts[-1]) < n:
            raise ValueError("a block is cut off")
        at += n + 1
    return b"".join(parts), at + 1


def gif_decode(data: bytes) -> Iterator[Frame]:
    """Frames in order; raises ValueError on damage, after the frames before it."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        full = np.zeros((256, 4), np.uint8)
        full[:, 3] = 255
        full[:n, :3] = table
        return full, at + 3 * n

    shared, at = palette(flags, 13) if flags & 0x80 else (None, 13)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, through = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, through = packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            colours, at = palette(flags, at + 10) if flags & 0x80 else (shared, at + 10)
            if colours is None:
                raise ValueError("a frame has no palette")
            root = data[at]
            if not 1 <= root <= 8:
                raise ValueError("a sample size out of range")
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, root, w * h)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            indices = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            before = canvas.copy() if disposal == 3 else None
            ch, cw = max(0, min(h, height - y)), max(0, min(w, width - x))
            seen, part = indices[:ch, :cw], canvas[y : y + ch, x : x + cw]
            drawn = colours[seen]
            if through is None:
                part[:] = drawn
            else:
                np.copyto(part, drawn, where=(seen != through)[..., None])
            yield Frame(x, y, w, h, delay, disposal, indices, canvas.copy())
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, through = 0, 0, None
        else:
            raise ValueError("an unknown block")


def histogram(rgba: np.ndarray) -> list[list[int]]:
    """Counts of each colour channel in ``BINS`` equal bins, over pixels that aren't transparent."""
    seen = rgba if rgba[..., 3].all() else rgba[rgba[..., 3] > 0]
    return [np.bincount(seen[..., c].ravel(), minlength=256).reshape(BINS, -1).sum(axis=1).tolist() for c in range(3)]


FRAMES = [
    T.StructField("frame", T.IntegerType()),
    T.StructField("begin_cs", T.LongType()),
    T.StructField("delay_cs", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()),
    *(T.StructField(f"hist_{c}", T.ArrayType(T.LongType())) for c in ("red", "green", "blue")),
    T.StructField("error", T.StringType()),
]


def frames(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each frame: its time, RGBA pixels of the whole canvas and histograms; ``error`` on a row of
    its own where the media end in damage."""
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *FRAMES])

    def rows(key, data: bytes | None) -> Iterator[tuple]:
        begin = 0
        try:
            for k, f in enumerate(gif_decode(data) if data is not None else ()):
                yield key, k, begin, f.delay, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), *histogram(f.canvas), None
                begin += f.delay
        except ValueError as e:
            yield key, None, begin, None, None, None, None, None, None, None, str(e)

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def batch_of(made: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            made, held = [], 0
            for key, data in zip(batch[id_col].to_pylist(), batch["media"], strict=True):
                for row in rows(key, data.as_py()):
                    made.append(row)
                    held += len(row[6] or b"")
                    if held > 16 << 20:
                        yield batch_of(made)
                        made, held = [], 0
            if made:
                yield batch_of(made)

    return media.select(F.col(id_col), F.col(media_col).alias("media")).mapInArrow(task, schema)


MEDIA = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]


def _by_part(df: DataFrame, schema: T.StructType, fn) -> DataFrame:
    """Apply ``fn`` to the columns of a few rows at a time, with ``PART_BYTES`` in the last column or a single row; it
    returns rows."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                n = min(PART, max(1, int(np.searchsorted(upto, before + PART_BYTES, "right")) - at))
                made = fn(*(c.to_pylist() for c in batch.slice(at, n).columns))
                at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)

    return df.mapInArrow(task, schema)


def _encoded(keys: list, texts: list[str]) -> list[tuple]:
    data = [t.encode() for t in texts]
    media = gif_encode([d + bytes([PADDING]) * ((-len(d)) % WIDTH if d else WIDTH) for d in data])
    return [*zip(keys, map(len, data), media, strict=True)]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id column, ``n_bytes`` of the UTF-8 text and ``media``, which holds the text padded to whole rows."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *MEDIA])
    return _by_part(docs.select(F.col(id_col), text_of(text_col).alias("text")), schema, _encoded)


DIGEST = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def _digest(key, n_bytes: int, media: bytes) -> tuple:
    hist, length, count, parts = np.zeros((3, BINS), np.int64), 0, 0, []
    for f in gif_decode(media):
        own = f.own()
        parts.append(np.ascontiguousarray(own[..., 0]).tobytes())
        hist += histogram(own)
        length, count = length + f.delay, count + 1
    payload = b"".join(parts)
    feature = f"frames={count};cs={length};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip("rgb", hist.tolist(), strict=True))
    return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored media; digests of what they hold, and the colour histogram over their frames."""
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *DIGEST])
    return _by_part(media.select(id_col, "n_bytes", "media"), schema, lambda *columns: [*map(_digest, *columns)])


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(stored(encode_texts(docs), "media"))
