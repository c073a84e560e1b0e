"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. The rendering is
encoded once, with the offsets of its tokens (of distinct segments, as ``token_records`` encodes; offsets follow from
the bytes of the tokens). The turns' spans lie sorted in the rendering, so the tokens of a
span are found by binary search on token ends and token starts. A token that reaches over an edge of a span
is in the mask with the part inside.

Rows are range-partitioned by conversation and turn, so a conversation of any share of the rows is dealt to many
tasks. A task renders the turns that it holds, in ``PARTS`` of so many characters at most or a single turn; a conversation that lies in
several tasks or is longer has several rows, in ascending ``part``. No piece of the tokenizer reaches over the end of a
turn, so its ids, joined, are those of the whole rendering. Nothing is gathered, and a task holds one part at a time.
Digests of a conversation in several parts are made by reading them in order, a part at a time.

Control strings in texts are escaped reversibly: ``<``, any number of backslashes, ``|im_start|>`` (or
``im_end``) gains one backslash after ``<``, and reading takes one away. Roles have backslashes and newlines
escaped as well, since a newline ends a role. So a rendering parses in one way only.

Defined cases: null roles and texts are empty; turns sort by turn (nulls first), role and text, and repeated
rows are each kept; a null conversation id is a conversation of its own; conversations of any length are encoded
whole; names of added tokens in texts are plain text; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, stored, text_of
from .token_records import SegmentEncoder

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
#: Characters of a part of a conversation, and of parts encoded together; segments of texts kept by a worker.
PARTS, TOGETHER, CACHE = 256 << 10, 1 << 20, 100_000

#: ``turns`` are the spans of the turns' texts, in code points of ``formatted``; ``mask`` lists the tokens
#: under the loss, ``mask_start`` and ``mask_end`` the part of the rendering each adds. ``whole`` tells that a
#: conversation surely has no other row.
FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("turn_start", T.ArrayType(T.IntegerType())),
        T.StructField("turn_end", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("mask", T.ArrayType(T.IntegerType())),
        T.StructField("mask_start", T.ArrayType(T.IntegerType())),
        T.StructField("mask_end", T.ArrayType(T.IntegerType())),
    ]
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*\|im_(?:start|end)\|>)", r"<\\\1", text) if "|im_" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*\|im_(?:start|end)\|>)", r"<\1", text) if "|im_" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and the span of each turn's text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering, unescaped; raises if it isn't one."""
    out = []
    for turn in formatted.split(START)[1:]:
        if not turn.endswith(END + "\n"):
            raise ValueError("a turn has no end")
        role, _, body = turn[: -len(END) - 1].partition("\n")
        out.append((unescape_role(role), unescape(body)))
    return out


def masked(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that overlap the sorted spans (``a``, ``b``), and the begin and end of what each covers.

    Tokens that share a character, which byte-level tokens may, cover it once.
    """
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    n = np.maximum(last - first, 0)
    span = np.repeat(np.arange(len(a)), n)
    tokens = np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(a) else np.zeros(0, np.int64)
    stop = np.minimum(ends[tokens], b[span])
    covered = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    covered = np.where(np.diff(span, prepend=-1) > 0, 0, covered)
    begin = np.maximum(np.maximum(starts[tokens], a[span]), covered)
    return tokens, begin, np.maximum(begin, stop)


class OffsetEncoder:
    """Ids of texts with the code points that each token covers."""

    def __init__(self, path: str):
        self.encoder = SegmentEncoder(path, CACHE, special=False)
        vocabulary = self.encoder.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # the alphabet has a character for each byte

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        import pyarrow as pa

        for text, payload in zip(texts, self.encoder.many(pa.array(texts, pa.string())), strict=True):
            ids = np.frombuffer(payload, f"<u{self.encoder.width}")
            stop = np.cumsum(self.size[ids], dtype=np.int32)
            begin = stop - self.size[ids]
            data = text.encode()
            if len(data) == len(text):
                yield ids, begin, stop
            else:
                place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
                yield ids, place[begin] - 1, place[stop - 1]


_ENCODERS: dict[str, OffsetEncoder] = {}


def encoder(path: str) -> OffsetEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = OffsetEncoder(path)
    return _ENCODERS[path]


def format_conversations(rows: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """The conversations of ``rows`` (conv_id, turn, role, text), rendered and masked, as ``FORMATTED``."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    dealt = turns.repartitionByRange(partitions(rows.sparkSession), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    def parts(batches: Iterator) -> Iterator[tuple]:
        """conv_id, whole and turns of each part, in order."""
        held: list[tuple[str, str]] = []
        chars, now, alone, first = 0, object(), True, True
        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != now:
                    if held:
                        yield now, alone and not first, held
                        first = False
                    now, held, chars, alone = conv_id, [], 0, True
                elif chars + len(text) > PARTS:
                    yield now, False, held
                    held, chars, alone = [], 0, False
                held.append((role, text))
                chars += len(text)
        if held:  # the last may go on in the next task
            yield now, False, held

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, code = to_arrow_schema(FORMATTED), encoder(tokenizer_path)
        at = TaskContext.get().partitionId() << 40
        some: list[tuple] = []
        chars = 0

        def made() -> Iterator:
            nonlocal at
            lists: list[list[np.ndarray]] = [[] for _ in range(6)]
            for (_, _, _, spans, told), (ids, starts, ends) in zip(some, code([r[2] for r in some]), strict=True):
                wanted = spans[told & (spans[:, 0] < spans[:, 1])]
                for c, v in zip(lists, (spans[:, 0], spans[:, 1], ids, *masked(wanted[:, 0], wanted[:, 1], starts, ends)), strict=True):
                    c.append(v)
            columns = [pa.array([r[0] for r in some], pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array([r[1] for r in some]), pa.array([r[2] for r in some], pa.string())]
            for c in lists:
                edges = np.concatenate([[0], np.cumsum([len(v) for v in c])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(c).astype(np.int32))))
            at += len(some)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for conv_id, whole, own in parts(batches):
            formatted, spans = render(own)
            some.append((conv_id, whole, formatted, np.array(spans, np.int64), np.array([role in trained for role, _ in own], bool)))
            chars += len(formatted)
            if chars >= TOGETHER or len(some) >= 1024:
                yield from made()
                some, chars = [], 0
        if some:
            yield from made()

    return dealt.mapInArrow(task, FORMATTED)


DIGEST = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
)


def loss_runs(formatted: str, begins: np.ndarray, stops: np.ndarray) -> list[str]:
    """The text under the mask, unescaped, a run for each text that tokens cover without a gap."""
    if not len(begins):
        return []
    cut = np.flatnonzero(begins[1:] != stops[:-1])
    return [unescape(formatted[a:b]) for a, b in zip(begins[np.concatenate([[0], cut + 1])].tolist(), stops[np.concatenate([cut, [len(stops) - 1]])].tolist(), strict=True)]


def digests(formatted: DataFrame) -> DataFrame:
    """From formatted conversations, read back: what their turns and masks hold."""
    names = ["conv_id", "part", "formatted", "mask_start", "mask_end"]

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(DIGEST)
        made: list[tuple] = []
        now, n, said, loss, loss_chars, chars = object(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        open_ = False
        for batch in batches:
            edges, begin, stop = batch["mask_start"].offsets.to_numpy(), batch["mask_start"].values.to_numpy(), batch["mask_end"].values.to_numpy()
            for k, (conv_id, text) in enumerate(zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), strict=True)):
                if conv_id != now:
                    if open_:
                        made.append((now, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, n, said, loss, loss_chars, chars, open_ = conv_id, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True
                turns = parse(text)
                n += len(turns)
                said.update("".join(f"{role}\n{body}\n" for role, body in turns).encode())
                own = "".join(loss_runs(text, begin[edges[k] : edges[k + 1]], stop[edges[k] : edges[k + 1]]))
                loss.update(own.encode())
                loss_chars, chars = loss_chars + len(own), chars + len(text)
            if made:
                yield batch_of(made)
                made = []
        if open_:
            yield batch_of([(now, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    rows = formatted.select("whole", *names)
    one = rows.filter("whole").select(names)
    more = rows.filter("not whole").select(names).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return one.mapInArrow(task, DIGEST).unionByName(more.mapInArrow(task, DIGEST))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(stored(format_conversations(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")), "chat"))
