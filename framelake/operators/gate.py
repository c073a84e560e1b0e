"""Quality gate: a manifest against a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Policy
from .duplicates import exact_groups, hashable

#: Share checks: name, flag, and whether it runs only below 100 %.
SHARES = (("max_corrupt_pct", "is_corrupt", False), ("max_overexposed_pct", "is_overexposed", False), ("max_underexposed_pct", "is_dark", False), ("max_duplicate_pct", "", False), ("max_blurry_pct", "is_blurry", True), ("max_artifact_pct", "has_border_artifact", True))


def report(manifest: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """ord, name, threshold, observed and passed of the checks that run. One pass over the rows, and one
    count by hash for duplicates."""
    valid = ~F.col("is_corrupt")
    formats = [f.upper() for f in policy.allowed_formats]
    bad_format = valid & ~F.upper(F.col("format")).isin(*formats) if formats else F.lit(False)
    row = manifest.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(flag)).alias(flag) for _, flag, _ in SHARES if flag],
        *[F.coalesce(F.min(F.when(valid, F.col(c))), F.lit(0)).alias(c) for c in ("width", "height")],
        F.count_if(bad_format).alias("bad_format"),
        F.coalesce(F.max(F.when(valid, F.col("aspect_ratio"))), F.lit(0.0)).alias("ratio"),
        F.count_if(valid).alias("valid"),
    )
    dups = exact_groups(manifest).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    row = row.withColumn("one", F.lit(1)).join(dups.withColumn("one", F.lit(1)), "one")

    def line(order: int, name: str, threshold: float, observed: Column, passed: Column, runs: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("name"), F.lit(float(threshold)).alias("threshold"), observed.cast("double").alias("observed"), passed.alias("passed"), runs.alias("runs"))

    some = F.col("n") > 0
    lines = [line(1, "min_images_total", policy.min_images_total, F.col("n"), some & (F.col("n") >= policy.min_images_total), F.lit(True))]
    for k, (name, flag, optional) in enumerate(SHARES):
        limit = getattr(policy, name)
        share = F.try_divide(F.col(flag or "duplicates") * 100.0, F.col("n"))
        lines.append(line(2 + k, name, limit, F.round(share, 2), share <= limit, some & F.lit(not optional or limit < 100)))
    for k, c in enumerate(("width", "height")):
        limit = getattr(policy, f"min_{c}")
        lines.append(line(8 + k, f"min_{c}", limit, F.col(c), (F.col("valid") == 0) | (F.col(c) >= limit), some & F.lit(limit > 0)))
    lines.append(line(10, "allowed_formats", 0.0, F.col("bad_format"), F.col("bad_format") == 0, some & F.lit(bool(formats))))
    lines.append(line(11, "max_aspect_ratio", policy.max_aspect_ratio, F.round("ratio", 2), F.col("ratio") <= policy.max_aspect_ratio, some & F.lit(policy.max_aspect_ratio > 0)))
    return row.select(F.inline(F.array(*lines))).filter("runs").drop("runs")


def passed(manifest: DataFrame, policy: Policy = Policy()) -> bool:
    return report(manifest, policy).agg(F.every("passed")).first()[0]


def samples(manifest: DataFrame, n: int = 10) -> DataFrame:
    """name, place and path of the first ``n`` rows that fail each share check, in manifest order.

    The rank limit is applied in each task before rows meet.
    """
    flagged = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag, _ in SHARES if flag]))
    rows = manifest.select(F.explode(flagged).alias("name"), F.lit(0).cast("bigint").alias("group"), "row_idx", "path")
    groups = exact_groups(manifest).select("phash", "first_idx")
    copies = hashable(manifest).join(groups, "phash").filter("row_idx <> first_idx").select(F.lit("max_duplicate_pct").alias("name"), F.col("first_idx").alias("group"), "row_idx", "path")
    order = W.partitionBy("name").orderBy("group", "row_idx")
    return rows.unionByName(copies).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("name", "place", "path")
