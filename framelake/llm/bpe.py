"""Byte-level BPE: vectorised pre-tokenization, cached pair merging, decoding.

Pre-tokenization uses no regex. Texts become one array of code points, each mapped to a symbol: a character
class, refined for an apostrophe that begins a contraction. A symbol is a function on the states of a small
automaton. The functions that symbols can compose to form a finite monoid, so a function is one byte and
composing two is one look-up in a table: an associative operation. The scan lays the symbols out in columns
of equal length, composes down all columns at once, scans the column totals, and applies each prefix to the
start state. A second table gives, from the state before a symbol, whether a piece begins there.

The pieces are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Each distinct piece is merged once, lowest rank first, and cached in two bounded generations. Code-point
offsets of pieces and byte offsets of tokens map ids back to the text.

Defined cases: null text is the empty text, with no ids, the digest of the empty string and no decoded bytes;
rows that repeat are each kept; long texts are cut at no point, as columns of the scan may begin anywhere; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, opened, text_of

#: Character classes: letter, number, other visible, space, other white space, apostrophe.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE = range(6)
#: Symbols of the automaton: the classes, apostrophes that begin a contraction of two or three characters,
#: a last white-space character of a run, as a space or not, and the begin of a text.
SYMBOLS = ("letter", "number", "other", "space", "white", "short", "long", "last_space", "last_white", "reset")
#: What the piece at hand is: none, a run of one class, a space a run may take, or the rest of a contraction.
STATES = ("none", "letter", "number", "other", "white", "space", "two", "one")
#: Characters put through the scan at a time.
SCAN_CHARS = 1 << 20
CACHE = 200_000


def _step(state: str, symbol: str) -> tuple[str, bool]:
    """The state after ``symbol`` and whether a piece begins at it."""
    if symbol == "reset":
        return "none", False
    if state == "two":
        return "one", False
    if state == "one":
        return "none", False
    if symbol in ("short", "long"):
        if state in ("other", "space"):
            return "other", state == "none"
        return ("one" if symbol == "short" else "two"), True
    if symbol in ("letter", "number", "other"):
        return symbol, state not in (symbol, "space")
    if symbol in ("space", "white"):
        return "white", state != "white"
    return ("space" if symbol == "last_space" else "none"), True


def _monoid() -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Table of compositions, the element of each symbol, the state each element leads to from the start,
    and the begin flags by state and symbol."""
    index = {s: i for i, s in enumerate(STATES)}
    own = [tuple(index[_step(s, x)[0]] for s in STATES) for x in SYMBOLS]
    elements = {tuple(range(len(STATES))): 0}
    todo = [*elements]
    while todo:
        f = todo.pop()
        for g in own:
            fg = tuple(g[i] for i in f)
            if fg not in elements:
                elements[fg] = len(elements)
                todo.append(fg)
    size = 1 << (len(elements) - 1).bit_length()
    table = np.zeros((size, size), np.uint16 if size > 256 else np.uint8)
    for f, i in elements.items():
        for g, j in elements.items():
            table[i, j] = elements.get(tuple(g[k] for k in f), 0)
    leads = np.zeros(size, np.uint8)
    for f, i in elements.items():
        leads[i] = f[0]
    begins = np.zeros((len(STATES), 16), bool)
    for s in STATES:
        for j, x in enumerate(SYMBOLS):
            begins[index[s], j] = _step(s, x)[1]
    return table, [elements[f] for f in own], leads, begins


_TABLES: dict[str, tuple] = {}


def tables() -> tuple:
    """Class of each code point, and the automaton; built once in a worker, from the Unicode properties."""
    if not _TABLES:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        classes = np.full(0x110000, OTHER, np.uint8)
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1]) + 1
                classes[a:b] = c
        classes[0x1C:0x20] = OTHER  # separators that are not White_Space
        classes[0x20], classes[0x27] = SPACE, QUOTE
        table, own, leads, begins = _monoid()
        _TABLES["all"] = classes, table, np.array(own + [0] * (16 - len(own)), table.dtype), leads, begins
    return _TABLES["all"]


def symbols(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each code point; texts end in a separator that counts as white space at an end."""
    c = classes[codes]
    out = np.array([0, 1, 2, 3, 4, 2], np.uint8)[c]
    n = len(codes)
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1] = c[1:], LETTER
    white = (c == SPACE) | (c == WHITE)
    visible_next = (nxt != SPACE) & (nxt != WHITE)
    last = np.flatnonzero(white & visible_next)
    out[last] = np.where(c[last] == SPACE, 7, 8)
    quotes = np.flatnonzero(c == QUOTE)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[short]], out[quotes[long]] = 5, 6
    return out


def prefixes(elements: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exclusive scan: the composition of all elements before each place."""
    n = len(elements)
    if n <= 64:
        out, f = np.zeros(n, table.dtype), 0
        for i, x in enumerate(elements.tolist()):
            out[i] = f
            f = int(table[f, x])
        return out
    rows = max(16, int(n**0.5) // 4)
    columns = -(-n // rows)
    grid = np.zeros(rows * columns, table.dtype)
    grid[:n] = elements
    down = np.ascontiguousarray(grid.reshape(columns, rows).T)
    flat, size = table.ravel(), np.uint32(table.shape[1])
    before = np.empty((rows, columns), table.dtype)
    f = np.zeros(columns, table.dtype)
    for r in range(rows):
        before[r] = f
        f = flat[f * size + down[r]]
    base = prefixes(f, table)
    for r in range(rows):
        before[r] = flat[base * size + before[r]]
    return before.T.ravel()[:n]


def starts(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Flags of the code points at which pieces begin; at ``resets`` separators stand that begin none."""
    classes, table, own, leads, begins = tables()
    s = symbols(codes, classes)
    s[resets] = 9
    state = leads[prefixes(own[s], table)]
    return begins[state, s]


def pieces(texts: list[str]) -> list[list[int]]:
    """Begins of the pieces of each text, in code points, with the text's length at the end."""
    # A space after each text: white space at a text's end then has no visible character after it ...
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    at = np.flatnonzero(starts(codes, ends))
    cuts = np.searchsorted(at, ends)
    out, begin, k = [], 0, 0
    for end, cut in zip(ends.tolist(), cuts.tolist(), strict=True):
        own = (at[k:cut] - begin).tolist()
        own.append(end - begin)
        out.append(own)
        begin, k = end + 1, cut
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    fs, p = opened(path)
    with fs.open_input_stream(p) as f:
        lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Encoding:
    """Encodes and decodes with a table of ranks; each distinct piece is merged once."""

    def __init__(self, path: str, size: int = CACHE):
        self.ranks = load_ranks(path)
        top = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.text_of = [str(i) for i in range(top)]
        self.size = size
        self.now: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join neighbours whose joint rank is lowest, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (got := ranks.get(piece)) is not None:
            return (got,)
        if len(piece) > 200:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple([ranks[p] for p in parts])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked parts, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        nxt, prev = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n and (r := ranks.get(both := part[i] + part[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, len(both)))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(i)
            push(prev[i])
        return tuple([ranks[p] for p in part if p is not None])

    def miss(self, piece: str) -> tuple[int, ...]:
        got = self.old.get(piece)
        if got is None:
            got = self.merge(piece.encode("utf-8", "replace"))
        if len(self.now) >= self.size:
            self.old, self.now = self.now, {}
        self.now[piece] = got
        return got

    def slices(self, text: str, cuts: list[int]) -> list[tuple[int, ...]]:
        """The ids of each piece of ``text``."""
        own = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [*map(self.now.get, own)]
        if None in got:
            got = [(self.now.get(p) or self.miss(p)) if g is None else g for p, g in zip(own, got, strict=True)]
        return got

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for a, b in chunks(texts, SCAN_CHARS):
            for text, cuts in zip(texts[a:b], pieces(texts[a:b]), strict=True):
                yield [*chain.from_iterable(self.slices(text, cuts))]

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Ids of each text, and begin and end of each id's bytes in its UTF-8 form."""
        for ids in self.encode(texts):
            ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
            yield ids, [0, *ends[:-1].tolist()][: len(ids)], ends.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODINGS: dict[tuple[str, int], Encoding] = {}


def encoding(path: str, size: int = CACHE) -> Encoding:
    """One encoding for each worker, file and size of its cache."""
    if (path, size) not in _ENCODINGS:
        _ENCODINGS[path, size] = Encoding(path, size)
    return _ENCODINGS[path, size]


def _mapped(docs: DataFrame, ranks: str, id_col: str, text_col: str, fields: list[T.StructField], row, size: int = CACHE) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, enc = to_arrow_schema(schema), encoding(ranks, size)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                texts = part["text"].to_pylist()
                made = [row(enc, t, ids) for t, ids in zip(texts, enc.encode(texts), strict=True)]
                if made:
                    yield pa.RecordBatch.from_arrays([part[id_col].cast(target[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), [*target][1:], strict=True))], schema=target)

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(task, schema)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id column, ``ids`` and ``ends`` (the byte each id's piece of the text ends at), without a shuffle."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    return _mapped(docs, ranks, id_col, text_col, fields, _with_ends)


def _with_ends(enc: Encoding, text: str, ids: list[int]):
    return ids, np.cumsum(enc.sizes[ids]) if ids else []


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id column and ``bytes``; null ids stay null."""
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())])

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, enc = to_arrow_schema(schema), encoding(ranks)
        for batch in batches:
            made = [None if x is None else enc.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[id_col].cast(target[0].type), pa.array(made, pa.binary())], schema=target)

    return tokens.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(task, schema)


def _digest(enc: Encoding, text: str, ids: list[int]):
    listed = " ".join(map(enc.text_of.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; the count and digests of ids and decoded bytes of each text."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, ranks, id_col, text_col, fields, _digest)


def _tokens(enc: Encoding, text: str, ids: list[int]):
    return ids, np.cumsum(enc.sizes[ids], dtype=np.int32) if ids else [], *_digest(enc, text, ids)


def tokens(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", size: int = CACHE // 2) -> DataFrame:
    """``round_trip`` with the ids themselves and ``ends``, the byte of the text that each ends at. Workers keep
    ``size`` pieces, fewer than else, as rows are larger."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, ranks, id_col, text_col, fields, _tokens, size)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
