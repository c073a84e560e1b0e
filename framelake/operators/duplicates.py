"""Exact groups, banded near-duplicate pairs and their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bits_apart, hamming, words64
from .graph import components, cut

BUCKET_CAP, THRESHOLD, BANDS = 500, 8, 4


def hashable(manifest: DataFrame) -> DataFrame:
    return manifest.filter("phash <> '' and not is_corrupt")


def exact_groups(manifest: DataFrame) -> DataFrame:
    """phash, count, first_path of hashes that two or more rows have. Members are joined, never gathered."""
    groups = hashable(manifest).groupBy("phash").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("row_idx", "path")).alias("first"))
    return groups.filter("count > 1").select("phash", "count", F.col("first.path").alias("first_path"), F.col("first.row_idx").alias("first_idx"))


def members(manifest: DataFrame) -> DataFrame:
    """phash, path and whether the row is its group's first."""
    rows = hashable(manifest).select("phash", "path", "row_idx")
    return rows.join(exact_groups(manifest).select("phash", "first_idx"), "phash").select("phash", "path", (F.col("row_idx") == F.col("first_idx")).alias("is_first"))


def duplicate_count(manifest: DataFrame) -> DataFrame:
    return exact_groups(manifest).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def near_pairs(manifest: DataFrame, threshold: int = THRESHOLD, cap: int | None = BUCKET_CAP, exact_recall: bool = False) -> DataFrame:
    """a, b (row_idx, a < b), path_a, path_b and distance of rows that share a band and lie near.

    By default a hash is cut into four equal bands, as digits; buckets of more than ``cap`` rows are skipped,
    which is part of the rule. ``exact_recall`` skips nothing (``exact_near_pairs``).
    """
    if exact_recall:
        return exact_near_pairs(manifest, threshold)
    rows = hashable(manifest).select("row_idx", "path", "phash")
    q = F.floor(F.length("phash") / BANDS).cast("int")
    banded = rows.select("*", F.posexplode(F.array(*[F.substring("phash", F.lit(1) + q * i, q) for i in range(BANDS)])).alias("band", "part"))
    if cap is not None:
        # Counted apart, with partial sums, so a hot bucket is never gathered just to be skipped.
        sizes = banded.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= cap))
        banded = banded.join(sizes.drop("n"), ["band", "part"], "left_semi")
    a, b = (banded.select("band", "part", F.col("row_idx").alias(s), F.col("path").alias(f"path_{s}"), F.col("phash").alias(f"h{s}")) for s in "ab")
    pairs = a.join(b, ["band", "part"]).filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= threshold)
    return pairs.select("a", "b", "path_a", "path_b", "distance").distinct()


def spread_masks(words: int, bands: int) -> list[list[int]]:
    """For each band its bits in each word, as signed 64-bit masks: bit number i is in band i modulo ``bands``.

    Neighbouring bits go to different bands, so bits that hardly vary (of rare digits, of an image's plain corner) don't
    meet in one band, whose buckets would hold nearly all rows.
    """
    masks = [[sum(1 << (63 - k) for k in range(64) if (64 * w + k) % bands == b) for w in range(words)] for b in range(bands)]
    return [[m - (1 << 64) if m >> 63 else m for m in band] for band in masks]


def with_keys(bits: DataFrame, words: int, bands: int) -> DataFrame:
    """Rows with a hash of ``words`` words in ``w``, once for each band, with a ``key`` of the band and its bits."""
    keys = [F.xxhash64(F.lit(b), *[F.col("w")[i].bitwiseAND(F.lit(m)) for i, m in enumerate(masks)]) for b, masks in enumerate(spread_masks(words, bands))]
    return bits.select("*", F.explode(F.array(*keys)).alias("key"))


def exact_near_pairs(manifest: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The columns of ``near_pairs`` without a miss: equal hashes are put together as one node (rows of a node hang on its
    first), and ``a`` and ``b`` are the first rows of nodes.

    The bits (of the longest hash, zeros before others) are dealt to threshold + 1 bands and no bucket is skipped, so no
    pair of nodes within the threshold can be missed. The hashes are read once and written to the shared folder.
    """
    rows = hashable(cut(manifest.select("row_idx", "path", "phash", "is_corrupt")))
    nodes = cut(rows.groupBy("phash").agg(F.min(F.struct("row_idx", "path")).alias("r")).select("r.*", "phash"))
    n = -(-(nodes.agg(F.max(F.length("phash"))).first()[0] or 16) // 16)
    bits = nodes.select("row_idx", "path", words64(F.col("phash"), n).alias("w")).filter("w is not null")
    banded = with_keys(bits, n, threshold + 1)
    a, b = (banded.select("key", F.col("row_idx").alias(s), F.col("path").alias(f"path_{s}"), F.col("w").alias(f"w{s}")) for s in "ab")
    distance = bits_apart(F.col("wa"), F.col("wb"), n)
    pairs = a.join(b, "key").filter("a < b").filter(distance <= threshold).withColumn("distance", distance)
    near = pairs.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("path_a", "path_b", "distance")])
    own = rows.join(nodes.select("phash", F.col("row_idx").alias("a"), F.col("path").alias("path_a")), "phash").filter("row_idx <> a")
    return near.unionByName(own.select("a", F.col("row_idx").alias("b"), "path_a", F.col("path").alias("path_b"), F.lit(0).alias("distance")))


def near_clusters(manifest: DataFrame, threshold: int = THRESHOLD, **how) -> DataFrame:
    """row_idx and cluster (the smallest row_idx reachable) of rows with a near pair."""
    return components(cut(near_pairs(manifest, threshold, **how).select("a", "b"))).select(F.col("node").alias("row_idx"), F.col("label").alias("cluster"))


def group_sizes(manifest: DataFrame) -> DataFrame:
    """Rows by group size; size 1 are all rows outside groups, corrupt ones too."""
    groups = exact_groups(manifest).groupBy(F.col("count").alias("group_size")).agg(F.count(F.lit(1)).alias("groups"))
    total = manifest.agg(F.count(F.lit(1)).alias("n"))
    held = exact_groups(manifest).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("held"))
    single = total.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").select(F.lit(1).cast("bigint").alias("group_size"), (F.col("n") - F.col("held")).cast("bigint").alias("groups"))
    return single.unionByName(groups.select("group_size", "groups"))
