"""Images that occur in more than one split: equal hashes, and near ones matched one to one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bits_apart, words64
from .graph import cut

THRESHOLD = 8


def with_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One table with a ``split`` column; labels are unique by construction."""
    if len(splits) < 2:
        raise ValueError("leakage needs two splits at least")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("split", F.lit(name)) for name, df in splits.items()))


def exact(rows: DataFrame) -> DataFrame:
    """path, phash, found_in (sorted split names, joined) of hashes that two splits share; a path once."""
    own = rows.filter("phash <> ''").select("path", "phash", "split", "row_idx")
    shared = own.groupBy("phash").agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("found_in"), F.count_distinct("split").alias("n")).filter("n > 1")
    found = own.join(shared.drop("n"), "phash")
    return found.groupBy("path").agg(F.min(F.struct("row_idx", "phash", "found_in")).alias("r")).select("path", "r.phash", "r.found_in")


def quarters(rows: DataFrame, width: int, n: int, side: str) -> DataFrame:
    """Each distinct hash once for each quarter it has."""
    parts = F.array_distinct(F.array(*[F.substring("phash", 1 + width * k, width) for k in range(4)]))
    hashes = rows.select("phash").distinct().withColumn("w", words64(F.col("phash"), n)).filter("w is not null")
    return hashes.select(F.explode(parts).alias("part"), F.col("phash").alias(f"phash_{side}"), F.col("w").alias(f"w{side}"))


def near_pairs(rows: DataFrame, order: Sequence[str], threshold: int = THRESHOLD, seen: DataFrame | None = None) -> DataFrame:
    """Pairs over each two splits (in ``order``) that share any quarter of their hashes and lie near, but not
    equal. The quarter's width comes from the first hash of the second split. Paths in ``seen`` take no part.

    Distinct hashes are compared, and rows are joined to those that lie near.
    """
    own = rows.filter("phash <> ''")
    # of each split its first hash's length, and the longest
    lengths = {r["split"]: r for r in own.groupBy("split").agg(F.min(F.struct("row_idx", F.length("phash").alias("n"))).alias("first"), F.max(F.length("phash")).alias("most")).collect()}
    n = -(-max([16, *(lengths[s]["most"] for s in order if s in lengths)]) // 16)
    if seen is not None:
        own = own.join(seen, "path", "left_anti")
    out = None
    for i, j in combinations(range(len(order)), 2):
        a, b = own.filter(F.col("split") == order[i]), own.filter(F.col("split") == order[j])
        width = max(1, lengths[order[j]]["first"]["n"] // 4) if order[j] in lengths else 4
        distance = bits_apart(F.col("wa"), F.col("wb"), n)
        near = quarters(a, width, n, "a").join(quarters(b, width, n, "b"), "part").filter("phash_a <> phash_b").filter(distance <= threshold)
        near = near.select("phash_a", "phash_b", distance.alias("distance")).distinct()
        a = a.select(F.col("row_idx").alias("idx_a"), F.col("path").alias("path_a"), F.col("phash").alias("phash_a")).distinct()
        b = b.select(F.col("path").alias("path_b"), F.col("phash").alias("phash_b")).distinct()
        pairs = near.join(a, "phash_a").join(b, "phash_b")
        pairs = pairs.select(F.lit(order[i]).alias("split_a"), F.lit(order[j]).alias("split_b"), "idx_a", "path_a", "phash_a", "path_b", "distance")
        # two hashes of one path may lie equally near
        pairs = pairs.distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def matched(pairs: DataFrame) -> DataFrame:
    """Near pairs of one pair of splits, each path at most once: idx_a, path_a, phash_a and path_b.

    Rows of the first split choose in manifest order, the nearest partner that is left first. All choose
    alike at the partner's side, so letting all rows ask at once, and each partner hold the earliest that
    asks, ends in the same matching; partners at equal distance are preferred in the order of a hash, so
    that few rows ask for the same one.
    """
    left = cut(pairs.select(F.struct("idx_a", "path_a").alias("a"), "phash_a", "path_b", F.struct("distance", F.md5(F.concat_ws("|", "path_a", "path_b")).alias("h"), "path_b").alias("liking")))
    while True:
        asks = cut(left.groupBy("a").agg(F.min(F.struct("liking", "phash_a")).alias("m")).select("a", F.col("m.phash_a").alias("phash_a"), F.col("m.liking.path_b").alias("path_b")))
        held = asks.groupBy("path_b").agg(F.min("a").alias("holder"), F.count(F.lit(1)).alias("n"))
        if held.filter("n > 1").isEmpty():
            return asks.select("a.*", "phash_a", "path_b")
        # A held partner never takes a later row than its holder, so all later rows' pairs with it are gone for good, asked or
        # not: a row doesn't go through partners one a round that it cannot win.
        left = cut(left.join(held.drop("n"), "path_b", "left").filter("holder is null or a <= holder").drop("holder"))


def report(rows: DataFrame, order: Sequence[str], threshold: int = THRESHOLD) -> DataFrame:
    """path, phash, found_in, match_type and matched_path of all leaks. The rows are read once."""
    rows = cut(rows.select("path", "phash", "split", "row_idx"))
    out = exact(rows).withColumn("match_type", F.lit("exact")).withColumn("matched_path", F.lit(None).cast("string"))
    if threshold > 0:
        seen = cut(out.select("path"))
        for a, b in combinations(order, 2):
            found = matched(near_pairs(rows, (a, b), threshold, seen))
            names = ",".join(sorted((a, b)))
            found = cut(found.select(F.col("path_a").alias("path"), F.col("phash_a").alias("phash"), F.lit(names).alias("found_in"), F.lit("near").alias("match_type"), F.col("path_b").alias("matched_path")))
            out = out.unionByName(found)
            seen = cut(seen.union(found.select("path")).union(found.select("matched_path")).distinct())
    return out.orderBy("path")
