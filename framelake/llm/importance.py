"""Quality by importance resampling: two hashed n-gram models, and a Gumbel top-k.

A text is a bag of hashed n-grams: words, pairs of words, word shapes and pairs of shapes (with a mark for a
word said twice in a row). The target model counts the n-grams of texts labelled good, the raw model those of
all texts. The log ratio of a text is log p_target - log p_raw of its whole bag, the sum over its n-grams; texts
unlike the target lie far below zero, the more so the longer they are.

Sampling k texts without replacement, each with probability in proportion to exp(ratio / temperature), is
taking the k largest of ratio / temperature + Gumbel noise. The noise comes from a seeded hash of the id, so
a run repeats. The temperature is ``TEMPERATURE``, the n-grams that a word is part of (itself, two pairs, and
their shapes), as these repeat one another's evidence. Where the evidence is clear the noise changes little; among
texts too short or too mixed to tell, it decides.

k is a budget: ``share`` of the texts that have words or, by default, the number of texts whose ratio reaches the
cut that splits the labelled texts best, so that the sample is as large as the clean part of the corpus.

The target and the cut are fitted on a bounded sample of labelled rows (``LABELLED``, those with the least
hashes); the raw model, k and the sample cover every text. A model is ``BUCKETS`` counts. The k-th largest key is
found by counts in ``BINS`` bins, narrowed round by round, so no task orders all texts.

Defined cases: null texts and texts without words have ratio null and are not taken; texts of any length are
read whole; without labels for both classes all others are taken; labels that are null are not used, repeated
ones count each; equal keys at the k-th place are all taken; rows that share an id share their noise, so equal
ones are taken together; a null id counts as the id 0 for noise; an empty table gives no rows; extra columns are
passed on, but those named as the ones added here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, forget, stored, text_of
from .hashing import BASES, mix, word_hashes

BUCKETS, LABELLED, TEMPERATURE, SEED = 1 << 14, 20_000, 6.0, 23
#: Added to each bucket's count, as a share of its model's mean.
SMOOTHING = 0.01
#: Characters of texts read at a time, or a single text.
TOGETHER = 1 << 18
#: Bins of a round, and keys that are few enough to be ordered.
BINS, FEW = 4096, 4096


def _classes() -> np.ndarray:
    """Of each byte: 0 upper case, 1 lower case or beyond ASCII, 2 digit, 3 other."""
    table = np.full(256, 3, np.uint8)
    table[65:91], table[97:123], table[128:], table[48:58] = 0, 1, 1, 2
    return table


def ngrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a few texts at a time: number of the first, text of each n-gram from there, and its bucket."""
    classes, odd, shift = _classes(), np.uint64(BASES[1]), np.uint64(64 - (BUCKETS.bit_length() - 1))
    for a, b in chunks(texts, TOGETHER):
        held = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
        begin, words = word_hashes(data)
        ends = np.cumsum([len(h) + 1 for h in held])
        owner = np.searchsorted(ends, begin, "right")
        if not len(begin):
            yield a, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        kind = classes[data]
        visible = (data != 32) & ~((data >= 9) & (data <= 13))
        stop = begin + np.add.reduceat(visible.astype(np.int64), begin)  # visible bytes up to the next word
        shape = np.zeros(len(begin), np.uint64)
        for c, most in ((0, 3), (1, 1), (2, 1), (3, 4)):
            count = np.concatenate([[0], np.cumsum(kind == c)])
            shape = shape * np.uint64(8) + np.minimum(count[stop] - count[begin], most).astype(np.uint64)
        edge = data[stop - 1]
        shape = mix(shape * np.uint64(256) + np.where(classes[edge] == 3, edge, 0))
        same = np.concatenate([[False], (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])])
        joined = owner[1:] == owner[:-1]
        pair = mix(words[:-1] * odd + words[1:])[joined]
        frame = mix((shape[:-1] * odd + shape[1:]) * np.uint64(2) + same[1:].astype(np.uint64))[joined]
        grams = np.concatenate([words, pair, mix(shape + np.uint64(1)), frame])
        yield a, np.concatenate([owner, owner[1:][joined], owner, owner[1:][joined]]), (mix(grams) >> shift).astype(np.int64)


def counted(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """N-grams of all texts by bucket: each task adds up its own, then ``BUCKETS`` sums are gathered."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for _, _, bucket in ngrams(batch["text"].slice(at, 1024).to_pylist()):
                    total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(task, "bucket long, n long")
    out = np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    def logs(n: np.ndarray) -> np.ndarray:
        smooth = n + SMOOTHING * max(n.mean(), 1e-9)
        return np.log(smooth / smooth.sum())

    return logs(target) - logs(raw)


def scored(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", name: str = "log_ratio") -> DataFrame:
    """``docs`` with their log ratio, null where a text has no words."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch[text_col].to_pylist()]
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for at in range(0, len(texts), 1024):
                for first, owner, bucket in ngrams(texts[at : at + 1024]):
                    size = len(texts) - at - first
                    total[at + first :] += np.bincount(owner, ratios[bucket], size)
                    n[at + first :] += np.bincount(owner, minlength=size)
            score = pa.array(total, mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=schema.names)

    return docs.mapInArrow(task, schema)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Between the two neighbours that split good from bad with the least summed error rates."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    left = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    split = np.concatenate([[True], s[1:] > s[:-1], [True]])
    k = int(np.argmin(np.where(split, lost + left, np.inf)))
    if k == 0:
        return -np.inf
    return float(s[k - 1] / 2 + s[k] / 2) if k < len(s) else float(s[-1]) + 1e-9


def kth_key(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column ``key``; -inf where there are fewer, inf for k < 1.

    Each round counts keys in ``BINS`` equal bins between the least and the largest that are left, and goes on
    with the bin that the k-th is in, until that holds ``FEW`` keys or one value.
    """
    if k < 1:
        return np.inf
    rest = k
    while True:
        low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
        if n < rest:
            return -np.inf
        if low == high:
            return low
        if n <= FEW:
            return keys.orderBy(F.desc("key")).limit(rest).agg(F.min("key")).first()[0]
        place = F.least(F.floor((F.col("key") - F.lit(low)) * F.lit(BINS / (high - low))), F.lit(BINS - 1)).cast("int")
        upto = 0
        for r in sorted(keys.groupBy(place.alias("bin")).count().collect(), reverse=True):  # BINS rows at most
            if upto + r["count"] >= rest:
                break
            upto += r["count"]
        rest -= upto
        keys = keys.filter(place == r["bin"])


def noise(doc_id, seed) -> Column:
    """Standard Gumbel noise of an id."""
    u = (F.pmod(F.xxhash64(seed, F.coalesce(doc_id.cast("long"), F.lit(0))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def sampled(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with log_ratio, gumbel_key and selected; ``labels``: doc_id, quality."""
    docs = docs.drop("log_ratio", "gumbel_key", "selected")
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good")).dropna()
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "good").limit(labelled)
    # No more than ``labelled`` ids are broadcast, so the texts aren't shuffled.
    own = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id"), "labelled")
    raw = counted(docs)
    target = counted(own.filter("good"))
    ratios = log_ratios(target, raw) if target.any() else np.zeros(BUCKETS)
    out = scored(docs, ratios).withColumn("gumbel_key", F.col("log_ratio") / F.lit(temperature) + noise(F.col("doc_id"), F.lit(seed + 1)))
    small = stored(out.select(F.col("gumbel_key").alias("key"), "log_ratio").dropna(), "keys")
    if share is not None:
        k = int(np.ceil(share * small.count()))
    else:
        known = scored(own, ratios).select("log_ratio", "good").dropna().limit(labelled).collect()
        cut = best_cut(np.array([r["log_ratio"] for r in known]), np.array([r["good"] for r in known], bool)) if known else -np.inf
        k = small.filter(F.col("log_ratio") >= F.lit(float(cut))).count()
    least = kth_key(small, k)
    forget(small, own)
    return out.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(float(least)), F.lit(False)))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", F.round("log_ratio", 9).alias("log_ratio"), F.round("gumbel_key", 6).alias("gumbel_key"), "selected")
