"""Near-duplicate components by HyperMinHash sketches, banding and exact confirmation.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Its sketch has ``REGISTERS`` buckets;
a bucket keeps, of the least hash in it, the count of leading zeros and ``MANTISSA`` bits after the first one,
in 16 bits. Empty buckets take another's value. ``BANDS`` runs of ``ROWS`` registers are hashed to band keys. Texts with one and the same set are
one class, represented by its smallest document id; only representatives go on.

1. In each band key the smallest id is the hub; every other member is paired with it, once. A pair goes on
   where the collision-corrected estimate isn't below the threshold by more than ``SIGMAS`` standard errors,
   and is judged on the full sets, computed again from the texts. Links are joined to components.
2. Where the members of a hub are of several components, those outside the most frequent one are held, in
   blocks, against all members of other components. 1 - J is a metric, so members whose distances to the hub
   differ by more than a link's distance can't be linked; others whose estimate is high enough are judged on
   full sets in their block, which returns no more links than it needs to join components. The components are
   then joined anew. Texts that share a key share its hub, so no link between them is lost.

Work in a group of n near copies thus grows with n and its stragglers, not with n squared, and no group is
gathered in one task. Links are never collected.

Two sets with similarity J share no band with probability (1 - J^ROWS)^BANDS: 2e-9 at 0.85, 3e-6 at 0.8; an
estimate more than ``SIGMAS`` standard errors low drops a pair with probability 3e-7. Sets are of 64-bit shingle
hashes, in ``n_shingles`` and in the confirmation alike: two shingles of a text of n are one with probability n^2 / 2^65.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts with fewer words than
k are one shingle; texts of any length are read whole; repeated rows are each kept with one result; rows that share an id are one document; a
null id is linked with nothing and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, forget, stored, text_of
from .hashing import BASES, mix, word_hashes

REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 6, 42
SIGMAS = 5.0
#: Members of a key compared at a time: those outside the most frequent component, and all.
BLOCK, PART = 1024, 2048
#: Characters of texts read at a time, or a single text.
TOGETHER = 1 << 18
#: Columns that stand beside those of the documents for a while.
OWN = ("_framelake_id", "_framelake_text")
#: Ids that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``."""
    out = []
    for a, b in chunks(texts, TOGETHER):
        held = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
        ends = np.cumsum([len(h) + 1 for h in held])
        begin, words = word_hashes(data)
        upto = np.searchsorted(begin, ends)
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            grams = grams * np.uint64(BASES[0]) + words[j : j + len(grams)]
        grams = mix(grams)
        first = 0
        for last in upto.tolist():
            n = last - first
            if n >= k:
                own = np.sort(grams[first : last - k + 1])
                keep = np.empty(len(own), bool)
                keep[:1] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[first:last]:
                        whole = whole * np.uint64(BASES[1]) + w
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            first = last
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: of the least hash in each bucket (its top bits), 1 + leading zeros of the
    rest, then the mantissa; 0 where the bucket is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    bits = 64 - (REGISTERS.bit_length() - 1)
    bucket = (hashes >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] & np.uint64((1 << bits) - 1)
    exponent = np.frexp(np.maximum(rest >> np.uint64(4), np.uint64(1)).astype(np.float64))[1] + 3  # place of the first one, exactly: 52 bits fit a double
    exponent = np.maximum(exponent, MANTISSA)
    mantissa = (rest >> (exponent - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((bits - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def _donors() -> np.ndarray:
    """For each bucket, all buckets in an order of its own."""
    rng = np.random.default_rng(REGISTERS)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def densified(registers: np.ndarray) -> np.ndarray:
    """Rows of registers whose empty buckets take the value of the first filled one in their order.

    Without this, texts with few shingles would share the bands of any common passage: a band with one filled
    bucket tells little. Filled so, each register of two sets is equal with probability J, as in MinHash.
    """
    out, order = registers.copy(), _donors()
    todo = np.flatnonzero((registers != 0).any(axis=1) & (registers == 0).any(axis=1))
    for k in range(REGISTERS):
        if not len(todo):
            break
        part = out[todo]
        taken = registers[todo][:, order[:, k]]
        out[todo] = part = np.where(part == 0, taken, part)
        todo = todo[(part == 0).any(axis=1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of paired sketches (rows) less expected chance collisions, and its standard error at 0.85.

    A collision of different least hashes has probability 0.17 phi / 2^MANTISSA, phi = 4x/(1+x)^2 with x the
    ratio of set sizes. The error counts the buckets that sets of that size fill, and a quarter more for the
    draws that filled the others.
    """
    x = na / np.maximum(nb, 1)
    chance = 0.169919487159739 * 4 * x / (1 + x) ** 2 / (1 << MANTISSA)
    filled = REGISTERS * -np.expm1(-np.maximum(na, nb) / REGISTERS)
    return (a == b).mean(axis=-1) - chance, 1.25 * np.sqrt(0.85 * 0.15 / filled)


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("registers", T.BinaryType())])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, set size, digest of the set (null if empty) and registers."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingles(part["text"].to_pylist(), k)
                registers = densified(np.array([sketch(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["text_key"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets, strict=True)], pa.binary()),
                    ],
                    names=SKETCH.names,
                )

    return docs.mapInArrow(task, SKETCH)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
ESTIMATED = T.StructType([*PAIR.fields, T.StructField("j", T.DoubleType()), T.StructField("error", T.DoubleType())])
JUDGED = T.StructType([*PAIR.fields, T.StructField("j", T.DoubleType()), T.StructField("linked", T.BooleanType())])


def _table(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(rows, REGISTERS)


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs with their estimate and its error."""
    own = reps.select("doc_id", "n", "registers")
    a = own.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    b = own.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                j, error = estimate(_table(batch["ra"], batch.num_rows), _table(batch["rb"], batch.num_rows), batch["na"].to_numpy(), batch["nb"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(j), pa.array(error)], names=ESTIMATED.names)

    return pairs.join(b, "b").join(a, "a").select("a", "b", "na", "ra", "nb", "rb").mapInArrow(task, ESTIMATED)


def fetched(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (doc_id), in one pass over the documents; few ids are broadcast, so that the other
    texts aren't shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return stored(docs.join(ids, "doc_id", "left_semi"), "candidate-texts")


def judged(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with their similarity on full sets, and whether 100 * intersection >= percent * union."""
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, held = None, None  # rows come sorted by a, the hub of many
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                j, linked = [], []
                for key, ta, own in zip(part["a"].to_pylist(), part["ta"], shingles(part["tb"].to_pylist(), k), strict=True):
                    if last != (key, ta):
                        last, held = (key, ta), shingles([ta.as_py()], k)[0]
                    both = len(np.intersect1d(held, own, assume_unique=True))
                    union = len(held) + len(own) - both
                    j.append(both / max(union, 1))
                    linked.append(both > 0 and 100 * both >= percent * union)
                if j:
                    yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(j), pa.array(linked)], names=JUDGED.names)

    made = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(task, JUDGED)
    return stored(made.groupBy("a", "b").agg(F.max("j").alias("j"), F.max("linked").alias("linked")), "judged")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node that has a link.

    Each round a node takes the least label among its own and its neighbours', then its label's label; the
    table of each round is written to the shared folder, so no lineage grows. It ends when nothing changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        moved = stored(met.join(up, "low").select("node", F.least("low", "above").alias("label"), (F.least("low", "above") < F.col("label")).alias("changed")), "labels")
        more = moved.filter("changed").limit(1).count()
        forget(labels)
        labels = moved.drop("changed")
        labels._framelake_path = moved._framelake_path
        if not more:
            forget(both)
            return labels


def band_keys(reps: DataFrame) -> DataFrame:
    """doc_id and the key of each band."""
    size = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + size * i, size)) for i in range(BANDS)])
    return reps.select("doc_id", F.explode(bands).alias("key"))


def compare_block(asks: np.ndarray, ids: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links that join components: rows that ask against the others.

    Each pair of different components is estimated and then judged on the full sets, unless links found here
    have joined them by then; so a block gives fewer links than it has rows.
    """
    size = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    rest = np.flatnonzero(~asks)
    flat = np.concatenate([place[begin[r] : begin[r + 1]] for r in rest])
    edges = np.concatenate([[0], np.cumsum(size[rest])])
    _, component = np.unique(label, return_inverse=True)
    root = np.arange(component.max() + 1)
    held = np.zeros(place.max() + 1, bool)
    a, b = [], []
    for i in np.flatnonzero(asks):
        other = root[component[rest]] != root[component[i]]
        near = np.flatnonzero(other & (np.maximum(low[rest] - high[i], low[i] - high[rest]) <= 1 - percent / 100 + 1e-9))
        j, error = estimate(registers[i], registers[rest[near]], size[i], size[rest[near]])
        near = near[j >= percent / 100 - SIGMAS * error]
        if not len(near):
            continue
        own = place[begin[i] : begin[i + 1]]
        held[own] = True
        if 4 * len(near) > len(rest):
            both = np.add.reduceat(held[flat], edges[:-1], dtype=np.int64)[near]
        else:
            both = np.array([np.count_nonzero(held[flat[edges[k] : edges[k + 1]]]) for k in near])
        held[own] = False
        union = size[i] + size[rest[near]] - both
        for k in near[(both > 0) & (100 * both >= percent * union)]:
            mine, its = root[component[i]], root[component[rest[k]]]
            if mine != its:
                root[root == its] = mine
                a.append(int(min(ids[i], ids[rest[k]])))
                b.append(int(max(ids[i], ids[rest[k]])))
    return a, b


def stragglers(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (hub, doc_id, low, high) of a hub that lie in different components; see step 2."""
    member = members.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    parts = member.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("hub").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1 and n > 2")
    mixed = mixed.select("hub", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    own = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    held = stored(member.join(mixed, "hub").join(reps.select("doc_id", "registers"), "doc_id").join(own, "doc_id"), "member-texts")
    dealt, row = F.xxhash64("doc_id"), ("doc_id", "label", "low", "high", "registers", "text")
    asked = held.filter(F.col("label") != F.col("top")).select("hub", F.pmod(dealt, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *row, F.lit(True).alias("asks"))
    offered = held.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(dealt, F.col("parts")).cast("int").alias("part"), *row, F.lit(False).alias("asks"))

    def compare(table):
        import pyarrow as pa

        asks = table["asks"].to_numpy()
        if not asks.any() or asks.all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, label, low, high = (table[c].to_numpy() for c in ("doc_id", "label", "low", "high"))
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        a, b = compare_block(asks, ids, label, low, high, registers, shingles(table["text"].to_pylist(), k), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = asked.unionByName(offered).repartition("hub", "block", "part")
    found = stored(both.groupBy("hub", "block", "part").applyInArrow(compare, PAIR), "straggler-links")
    forget(held)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), kept and text_key (the text's hash), for
    every row."""
    similarity = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    every = stored(sketches(docs, k), "sketches")
    own = every.filter("set_key is not null and doc_id is not null")
    # One row for each set; copies meet before the shuffle.
    reps = stored(own.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "registers")).alias("r")).select("set_key", "r.*"), "representatives")
    keys = band_keys(reps)
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = stored(keys.join(hubs.select("key", "a"), "key").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "star")
    guessed = stored(estimated(star, reps), "estimates")
    ids = stored(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    texts = fetched(docs, ids)
    forget(star)
    known = judged(guessed.filter(F.col("j") >= similarity - SIGMAS * F.col("error")).select("a", "b"), texts, k, percent)
    links = known.filter("linked").select("a", "b")
    labels = components(links)
    exact = known.select("a", "b", F.col("j").alias("exact"))
    low = F.coalesce(1 - F.col("exact"), 1 - F.col("j") - SIGMAS * F.col("error"))
    high = F.coalesce(1 - F.col("exact"), 1 - F.col("j") + SIGMAS * F.col("error"))
    members = guessed.join(exact, ["a", "b"], "left").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), low.alias("low"), high.alias("high"))
    own_hubs = guessed.select(F.col("a").alias("hub"), F.col("a").alias("doc_id"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).distinct()
    more = stragglers(members.unionByName(own_hubs), labels, reps, texts, k, percent)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    forget(more, known, guessed, texts, ids)
    classes = reps.select("set_key", F.col("doc_id").alias("rep")).join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    out = every.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(classes, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without rows that a smaller id of their component stands for; of rows that share an id and a text, one.

    Rows that share an id but not a text are judged each by its own text. Rows with a null id stay.
    """
    text = text_of()
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias(OWN[0]), F.col("text_key").alias(OWN[1])).distinct()
    here = [F.col("doc_id").cast("long") == F.col(OWN[0]), F.xxhash64(text) == F.col(OWN[1])]
    rest = docs.join(gone, here, "left_anti")
    twice = stored(docs.groupBy("doc_id", F.xxhash64(text).alias(OWN[1])).count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias(OWN[0]), OWN[1]), "repeated")
    if twice.limit(1).count():
        same = rest.join(twice, here, "left_semi").withColumn(OWN[1], F.xxhash64(text)).dropDuplicates(["doc_id", OWN[1]])
        rest = rest.join(twice, here, "left_anti").unionByName(same.drop(OWN[1]))
    return rest.select(docs.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85).drop("text_key")
