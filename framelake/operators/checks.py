"""Quality checks of a manifest: filters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.columns import issues
from . import duplicates as dup


def corrupt(manifest: DataFrame) -> DataFrame:
    return manifest.filter("is_corrupt").select("path", "filename")


def exposure(manifest: DataFrame) -> DataFrame:
    found = F.concat_ws(",", F.when(F.col("is_dark"), F.lit("dark")), F.when(F.col("is_overexposed"), F.lit("overexposed")))
    return manifest.filter("is_dark or is_overexposed").select("path", found.alias("issues"), F.col("pixel_stats.mean_brightness").alias("mean_brightness"))


def artifacts(manifest: DataFrame) -> DataFrame:
    return manifest.filter("has_border_artifact").select("path", F.col("corner_stats.delta").alias("delta"))


def blur(manifest: DataFrame) -> DataFrame:
    return manifest.filter("is_blurry").select("path", "blur_score")


def flags(manifest: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The threshold flags from stored statistics; comparisons are strict."""

    def over(condition):
        return F.coalesce(condition, F.lit(False))

    brightness = F.col("pixel_stats.mean_brightness")
    return manifest.withColumns(
        {
            "is_dark": over(brightness < config.dark_threshold),
            "is_overexposed": over(brightness > config.overexposed_threshold),
            "has_border_artifact": over(F.col("corner_stats.delta") > config.artifact_threshold),
            "is_blurry": over(F.col("blur_score") < config.blur_threshold),
        }
    )


def flagged(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with any flag and their issues; the first ``limit`` in manifest order for a report."""
    found = manifest.select("row_idx", "path", issues().alias("issues")).filter("issues <> ''")
    return (found if limit is None else found.orderBy("row_idx").limit(limit)).select("path", "issues")


def everything(manifest: DataFrame, threshold: int = 8) -> DataFrame:
    """One row of counts: the flags, duplicate images, exact groups and near groups."""
    row = manifest.agg(*[F.count_if(c).alias(n) for c, n in (("is_corrupt", "corrupt"), ("is_dark", "dark"), ("is_overexposed", "overexposed"), ("has_border_artifact", "artifacts"))])
    exact = dup.exact_groups(manifest).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_images"), F.count(F.lit(1)).alias("exact_groups"))
    near = dup.near_clusters(manifest, threshold).agg(F.count_distinct("cluster").alias("near_groups"))
    # Three tables of one row each.
    return row.withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one").join(near.withColumn("one", F.lit(1)), "one").drop("one")
