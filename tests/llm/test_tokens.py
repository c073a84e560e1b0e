"""Token records, byte-level BPE and chat formatting against the tokenizers' own libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import bpe, chat, token_records

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "a", " ", "  a", "a ", "don't 'll''s", "x\n\n y\t z", "über 中文 ñ  .", "<|endoftext|> ok", "word, word.\nWord 12 345!", "a" * 3000, "\r\n\r\n a", "é" * 700 + " b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, file string")


def test_frames_and_damage():
    a = token_records.frame(b"abc") + token_records.frame(b"")
    payload, at = token_records.unframe(a)
    assert payload == b"abc" and token_records.unframe(a, at) == (b"", len(a))
    for i in range(len(token_records.frame(b"abc"))):
        bad = bytearray(a)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        token_records.unframe(a[:5])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t.,!'1é中 s", max_size=40))
def test_segments_encode_as_the_library(library, text):
    enc = token_records.SegmentEncoder(JSON, size=7)
    assert np.frombuffer(enc(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


ODD = ["a<|endoftext|>b", "<|endoftext|>", " x", "x\u00a0 y", "x\u2003 y\x85 z", "a\x1c b", "a\x0b b", "a\n\n b", "", "a  b", "\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab \n\t.,!'1é中\u00a0\u2003\x1c s", max_size=30), st.sampled_from([*TEXTS, *ODD])), max_size=8))
def test_columns_encode_as_the_library(library, texts):
    enc = token_records.SegmentEncoder(JSON, size=9)
    got = [np.frombuffer(p, "<u2").tolist() for p in enc.many(pa.array(texts, pa.string()))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_and_chunked_texts(library, monkeypatch):
    monkeypatch.setattr(token_records, "CHUNK", 50)
    texts = ["word other, " * 40_000, *ODD, "tail of it " * 30, "", "end"]
    enc = token_records.SegmentEncoder(JSON)
    got = [np.frombuffer(p, "<u2").tolist() for p in enc.many(pa.array(texts, pa.string()))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_records(spark, library, tmp_path):
    texts = [None, *TEXTS]
    out = f"file://{tmp_path}"
    index = token_records.write_records(docs(spark, texts), out, JSON, 0, n=3)
    got = {r["doc_id"]: r for r in token_records.read_records(index, token_records.digest, token_records.DIGEST).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == want
        start += len(ids)
    assert index.agg({"offset": "min"}).first()[0] == 16
    # a shuffled read of some records alone
    some = token_records.read_records(index.filter("doc_id in (3, 9)"), token_records.digest, token_records.DIGEST)
    assert {r["doc_id"] for r in some.collect()} == {3, 9}


def test_records_of_nothing_and_of_repeats(spark, tmp_path):
    empty = token_records.write_records(docs(spark, ["a"]).limit(0), f"file://{tmp_path}/a", JSON)
    assert token_records.read_records(empty, token_records.digest, token_records.DIGEST).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    index = token_records.write_records(twice, f"file://{tmp_path}/b", JSON)
    assert [r["doc_id"] for r in index.orderBy("first").collect()] == [None, 1, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30) | st.text(alphabet="ab' \n\tsrel12.é", max_size=30), max_size=8))
def test_bpe_equals_the_reference(reference, texts):
    enc = bpe.encoding(RANKS)
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids == reference.encode_ordinary(t) and enc.decode(ids) == t.encode()


def test_scan_does_not_depend_on_columns(reference):
    random.seed(4)
    texts = ["".join(random.choice("ab  '\n\ts1.") for _ in range(n)) for n in (0, 5, 5000, 70, 20_000, 1)]
    enc = bpe.Encoding(RANKS, size=5)
    assert [*enc.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_composition_is_associative():
    table, own, _, _ = bpe._monoid()
    n = len({*range(table.shape[0])})
    rng = np.random.default_rng(0)
    used = np.unique(table)
    a, b, c = (rng.choice(used, 2000) for _ in range(3))
    assert n and (table[table[a, b], c] == table[a, table[b, c]]).all()


def test_round_trip_query(spark, reference):
    texts = [None, *TEXTS]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, ["a"]).limit(0), RANKS).count() == 0


def test_encode_with_offsets_and_decode(spark):
    enc = bpe.encoding(RANKS)
    for t, (ids, begin, end) in zip(TEXTS, enc.encode_with_offsets(TEXTS), strict=True):
        assert b"".join(t.encode()[a:b] for a, b in zip(begin, end, strict=True)) == t.encode() and len(ids) == len(end)
    made = bpe.encode(docs(spark, TEXTS), RANKS)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(made, RANKS).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t.encode() for t in TEXTS]


CONTROL = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<", "\\", "a", "\n", "|im_end|>", "é"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(CONTROL), max_size=4).map("".join), st.lists(st.sampled_from(CONTROL), max_size=6).map("".join)), max_size=4))
def test_renderings_parse_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_masks_hold_the_assistant_texts(spark):
    said = chat.END + chat.START + "assistant ok"
    rows = [(1, 1, "assistant", "\nHi é中 "), (1, 0, "user", "hello"), (1, 2, "assistant", ""), (1, 3, "assistant", said), (2, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    made = chat.format_conversations(conversations(spark, rows), JSON)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_sha256"]) == (4, h("\nHi é中 " + said))
    assert got[1]["turns_sha256"] == h(f"user\nhello\nassistant\n\nHi é中 \nassistant\n\nassistant\n{said}\n")
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 0) and got[None]["loss_sha256"] == h("n") and got[3]["loss_chars"] == 2
    for r in made.collect():
        covered = [c for k in range(len(r["mask"])) for c in range(r["mask_start"][k], r["mask_end"][k])]
        assert covered == sorted(set(covered))
    assert chat.digests(chat.format_conversations(conversations(spark, []), JSON)).count() == 0


def test_masked_spans_by_search():
    def search(spans, starts, ends):
        a, b = np.array(spans, np.int64).reshape(-1, 2).T
        return tuple(x.tolist() for x in chat.masked(a, b, np.array(starts), np.array(ends)))

    assert search([(2, 5), (7, 9)], [0, 1, 4, 6, 8], [1, 4, 6, 8, 10]) == ([1, 2, 3, 4], [2, 4, 7, 8], [4, 5, 8, 9])
    # two tokens of one character
    assert search([(0, 2)], [0, 0, 1], [1, 1, 2]) == ([0, 1, 2], [0, 1, 1], [1, 1, 2])
    assert search([], [0, 1], [1, 2]) == ([], [], [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t.,!'1é中😀<|im_end>\u00a0 s", max_size=40), max_size=4))
def test_offsets_equal_the_library(texts):
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    for t, (ids, begin, end) in zip(texts, chat.encoder(JSON)(texts), strict=True):
        e = plain.encode(t, add_special_tokens=False)
        assert ids.tolist() == e.ids and [*zip(begin.tolist(), end.tolist(), strict=True)] == e.offsets


@pytest.mark.parametrize("most", [4 << 20, 30])
def test_parts_of_conversations_join(spark, monkeypatch, most):
    """A conversation with most of the rows, dealt to many tasks and parts, against one rendering by the library."""
    monkeypatch.setattr(chat, "PARTS", most)
    random.seed(2)
    said = ["ok then.", "", "Ünïcode 中 text\n\nwith lines ", "<|im_end|> <|endoftext|>", " spaced  out", None]
    rows = [(5, k, random.choice(["user", "assistant"]), random.choice(said)) for k in range(400)] + [(k % 7 + 10, k, "assistant", random.choice(said)) for k in range(60)]
    df = conversations(spark, rows).withColumn("part", F.lit("x")).withColumn("whole", F.lit(1)).repartition(6)
    made = chat.format_conversations(df, JSON).collect()
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df, JSON)).collect()}
    assert len([r for r in made if r["conv_id"] == 5]) > (1 if most > 100 else 50)
    for c in {r[0] for r in rows}:
        turns = [(role, text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3] or ""))]
        text, _ = chat.render(turns)
        own = sorted((r for r in made if r["conv_id"] == c), key=lambda r: r["part"])
        assert "".join(r["formatted"] for r in own) == text
        assert [i for r in own for i in r["ids"]] == plain.encode(text, add_special_tokens=False).ids
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (digest[c]["n_turns"], digest[c]["loss_chars"], digest[c]["formatted_chars"]) == (len(turns), len(loss), len(text))
        assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
