"""Token-ID output as length-delimited binary records with a separate offset index.

A shard file is a 16-byte header followed by records. A record frames one serialized sequence:

    length   uint64 little-endian, bytes of the payload
    check    uint32, masked CRC-32 of the eight length bytes
    payload  token ids, little-endian; uint16 where the vocabulary allows, else uint32
    check    uint32, masked CRC-32 of the payload

The mask rotates a checksum right by 15 bits and adds a constant, so that checksums of data which hold
checksums stay useful. The index is a Parquet table with a row for each record (doc_id, file, shard,
offset, length, n_tokens, first); a reader seeks to the records it wants in any order, for shuffled epochs.

Range partitioning on the document id puts shards and the records in them in ascending order. A task writes
its shard under a name of its own attempt and returns the index rows through Spark, so only files of the
attempt that counted are referenced: a lost executor leaves an unreferenced file, never a double record.

Texts that name an added token of the vocabulary get its id, as the library gives by default; such texts and
those with odd spacing are encoded one by one, all others by their distinct segments.

Defined cases: null text is the empty text (a record with the end id alone); a text of any length is one
record, encoded whole; null ids sort first; rows that repeat an id are each kept, ordered by text; an empty
table gives no shard and an empty index; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import opened, partitions, shared_path, stored, text_of

MAGIC = b"TOKREC\x00\x01"
#: The header: magic, bytes of an id, padding.
HEADER = "<8sII"
MASK_DELTA = 0xA282EAD8
#: Distinct segments kept in a worker's cache, per generation.
CACHE = 500_000
#: Bytes of payloads a read batch holds; bytes of texts encoded at a time.
READ_BYTES, CHUNK = 8 << 20, 8 << 20

INDEX = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("first", T.LongType()),
    ]
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place of the next; raises on damage."""
    head = data[at : at + 8]
    if len(head) < 8:
        raise ValueError(f"record at {at}: cut off")
    (n,), (check,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
    if check != masked(head):
        raise ValueError(f"record at {at}: length checksum differs")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"record at {at}: payload checksum differs")
    return payload, at + 16 + n


# A space that doesn't begin a piece of its own: at the start of a text, or after white space.
_SPACED = re.compile(r"\s |^ ")
_SPACED_RE2 = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |^ "
_CUT = re.compile(r"(?<=\S)(?= )")
_LINES = re.compile(r"(?<=\S)(\n+)(?=\S)")
_TAIL = ".,!?;:"


class SegmentEncoder:
    """Encodes whole texts as the tokenizers library does, each distinct segment once.

    Byte-level pre-tokenization starts a piece at every run of white space, and merges never cross pieces.
    So ids of a text are the ids of its segments, each cut before a space that follows a visible character,
    joined. The library encodes what the cache lacks; texts that hold an added token go to it whole. Two
    generations bound the cache.
    """

    def __init__(self, path: str, size: int = CACHE, special: bool = True):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special  # if not, names of added tokens are plain text
        self.model = self.tok.model.tokenize
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if special else []
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.size = size
        #: Ids by segment: those that a space comes before, and others.
        self.held: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in visible else chr(next(rest)) for b in range(256)}
        self.space = self.alphabet.pop(32)
        self.newline = self.alphabet.pop(10)
        self.packers = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)]

    def pack(self, ids) -> bytes:
        if len(ids) < 64:
            return self.packers[len(ids)](*ids)
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def library(self, s: str) -> bytes:
        return self.pack(self.tok.encode(s, add_special_tokens=False).ids)

    def miss(self, seg: str, space: bool) -> bytes:
        """A segment that isn't letters and the punctuation after them."""
        if "\n" in seg and len(parts := _LINES.split(seg)) > 1:
            # Before a visible character the last of several newlines is a piece of its own.
            lines = [q for k, p in enumerate(parts[1:]) for q in ((p[1:], "\n") if k % 2 == 0 else (p,)) if q]
            return b"".join(self.several([parts[0]], space) + self.several(lines, False))
        return self.library(" " + seg if space else seg)

    def several(self, segs: list[str], space: bool) -> list[bytes]:
        """The ids of segments, none of them empty unless after a space."""
        held, old = self.held[not space], self.old[not space]
        bodies = [b if (b := s.rstrip(_TAIL)) is s or b and b[-1].isalpha() else s for s in segs]
        words = []
        for b in dict.fromkeys(b for b in bodies if b not in held):
            if (got := old.get(b)) is not None:
                held[b] = got
            elif b.isalpha():
                words.append(b)
            else:
                held[b] = self.miss(b, space)
        if words:  # each is one piece: the library's model alone
            before = self.space if space else ""
            for b, spelled in zip(words, "\n".join(words).encode().decode("latin-1").translate(self.alphabet).split("\n"), strict=True):
                held[b] = self.pack([t.id for t in self.model(before + spelled)])
        return [held[b] if b is s else held[b] + self.tail(s[len(b) :]) for s, b in zip(segs, bodies, strict=True)]

    def tail(self, s: str) -> bytes:
        if not s:
            return b""
        if (got := self.held[1].get(s)) is None:
            got = self.held[1][s] = self.library(s)
        return got

    def rotate(self) -> None:
        if len(self.held[0]) + len(self.held[1]) >= self.size:
            self.old, self.held = self.held, ({}, {})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.pack(self.tok.encode(text, add_special_tokens=False).ids)
        if _SPACED.search(text):
            segs = _CUT.split(text)
            spaced = iter(self.several([s[1:] for s in segs if s[0] == " "], True))
            bare = iter(self.several([s for s in segs if s[0] != " "], False))
            out = b"".join(next(spaced if s[0] == " " else bare) for s in segs)
        else:
            first, *segs = text.split(" ")
            out = b"".join(self.several([first], False) + self.several(segs, True))
        self.rotate()
        return out

    def many(self, texts) -> list[bytes]:
        """The ids of an Arrow array of texts without nulls: its distinct segments are found and put back by
        Arrow, a chunk of ``CHUNK`` bytes (or a single text) at a time."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = [b""] * len(texts)
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _SPACED_RE2)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[plain])])
        begin = 0
        while begin < len(plain):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + CHUNK, "right")) - 1)
            own, begin = plain[begin:end], end
            parts = pc.split_pattern(texts.take(pa.array(own)), " ")
            at = parts.offsets.to_numpy().astype(np.int64)
            coded = parts.flatten().dictionary_encode()
            known, place = coded.dictionary, coded.indices.to_numpy().copy()
            first = known.take(pa.array(place[at[:-1]])).to_pylist()  # no space before these
            bare = iter(self.several([s for s in first if s], False))
            place[at[:-1]] = len(known) + np.arange(len(own))
            values = self.several(known.to_pylist(), True) + [next(bare) if s else b"" for s in first]
            joined = pa.array(values, pa.large_binary()).take(pa.array(place))
            self.rotate()
            _, offsets, data = joined.buffers()
            ends = np.frombuffer(offsets, np.int64)[joined.offset :][at].tolist()
            held = memoryview(data) if data is not None else b""
            for i, a, b in zip(own.tolist(), ends, ends[1:], strict=False):
                out[i] = bytes(held[a:b])
        return out


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each worker and file; workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """Encode whole texts to shards below ``out``; returns the offset index, stored at ``out``/index.

    ``end_id`` is appended to each sequence. ``first`` counts the ids of all records before one. ``n``
    partitions give as many shards; the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranged = rows.repartitionByRange(n or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        tail = b"" if end_id is None else enc.pack([end_id])
        fs = sink = uri = None
        at = first = 0
        try:
            for batch in batches:
                cols: list[list] = [[] for _ in INDEX]
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.many(batch["text"]), strict=True):
                    if sink is None:
                        uri = f"{out}/data/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
                        fs, path = opened(uri)
                        fs.create_dir(path.rpartition("/")[0])
                        sink = fs.open_output_stream(path)
                        at = sink.write(struct.pack(HEADER, MAGIC, enc.width, 0))
                    payload = ids + tail
                    sink.write(rec := frame(payload))
                    for c, v in zip(cols, (doc_id, shard, uri, at, len(rec), len(payload) // enc.width, first), strict=True):
                        c.append(v)
                    at, first = at + len(rec), first + len(payload) // enc.width
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=INDEX.names)
        finally:
            if sink is not None:
                sink.close()

    local = stored(ranged.mapInArrow(task, INDEX), "record-index")
    # A row for each shard; there are no more shards than partitions.
    totals = local.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("base"))
    index = local.join(F.broadcast(base), "shard").select(*[c for c in INDEX.names if c != "first"], (F.col("first") + F.col("base")).alias("first"))
    index.write.parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")


def read_records(index: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Read the records that ``index`` lists and apply ``fn(doc_id, first, ids) -> tuple`` to each.

    Neighbouring records are read together; every checksum is verified.
    """
    near = index.select("doc_id", "file", "offset", "length", "first", F.floor(F.col("offset") / READ_BYTES).alias("near"))
    dealt = near.repartition("file", "near").sortWithinPartitions("file", "offset")

    def task(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, source, name, width = to_arrow_schema(schema), None, None, 2
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("doc_id", "file", "offset", "length", "first")), strict=True))
            i, made = 0, []
            while i < len(rows):
                _, file, begin, length, _ = rows[i]
                j, end = i + 1, begin + length
                while j < len(rows) and rows[j][1] == file and rows[j][2] == end and end - begin < READ_BYTES:
                    end += rows[j][3]
                    j += 1
                if file != name:
                    if source is not None:
                        source.close()
                    fs, path = opened(file)
                    source, name = fs.open_input_file(path), file
                    magic, width, _ = struct.unpack(HEADER, source.read_at(struct.calcsize(HEADER), 0))
                    if magic != MAGIC:
                        raise ValueError(f"{file}: not a record file")
                data = source.read_at(end - begin, begin)
                for doc_id, _, offset, _, first in rows[i:j]:
                    payload, _ = unframe(data, offset - begin)
                    made.append(fn(doc_id, first, np.frombuffer(payload, f"<u{width}")))
                i = j
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)
        if source is not None:
            source.close()

    return dealt.mapInArrow(task, schema)


def digest(doc_id, first, ids):
    return doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = write_records(docs, shared_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_records(index, digest, DIGEST)
