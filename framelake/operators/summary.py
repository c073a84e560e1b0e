"""Dataset summary and category counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import extension


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def summary(manifest: DataFrame) -> DataFrame:
    """One row: totals and flags over all rows, sizes over those that aren't corrupt; zeros when empty."""
    valid = ~F.col("is_corrupt")

    def size(f, c: str) -> Column:
        return F.coalesce(f(F.when(valid, F.col(c))), F.lit(0)).alias(f"{f.__name__}_{c}")

    return manifest.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        _count(F.col("is_corrupt"), "corrupt_count"),
        _count(F.col("is_dark"), "dark_count"),
        _count(F.col("is_overexposed"), "overexposed_count"),
        _count(F.col("has_border_artifact"), "artifact_count"),
        _count(F.col("is_blurry"), "blurry_count"),
        size(F.min, "width"), size(F.max, "width"), size(F.min, "height"), size(F.max, "height"),
        *_exif(),
    )


def _exif() -> list[Column]:
    return [
        _count(F.col("camera_make").isNotNull() & (F.col("camera_make") != ""), "exif_count"),
        _count(F.col("distortion_risk") == "high", "high_distortion_count"),
        _count(F.col("has_gps_data"), "gps_count"),
        _count(F.col("orientation_tag") != 1, "rotated_count"),
    ]


def exif_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(*_exif())


#: Dimension and the column or expression it counts.
DIMENSIONS: dict[str, Column | str] = {"format": "format", "color_mode": "color_mode", "extension": "", "camera_make": "camera_make", "camera_model": "camera_model"}


def _value(dimension: str) -> Column:
    return extension(F.col("filename")) if dimension == "extension" else F.col(dimension)


def ranked(counts: DataFrame, by: list[str], *parts: str) -> DataFrame:
    """Add ``rank``: count descending, then first seen. Rows are categories, few beside the rows counted."""
    order = W.partitionBy(*parts).orderBy(F.desc("count"), "first_idx") if parts else W.orderBy(F.desc("count"), "first_idx")
    return counts.withColumn("rank", F.row_number().over(order)).select(*by, "count", "rank")


def category_counts(manifest: DataFrame, dimension: str) -> DataFrame:
    """key, count, rank; empty and null values aren't counted."""
    rows = manifest.select(_value(dimension).alias("key"), "row_idx").filter("key <> ''")
    return ranked(rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("row_idx").alias("first_idx")), ["key"])


def all_category_counts(manifest: DataFrame) -> DataFrame:
    """All five dimensions in one pass: dimension, key, count, rank."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), _value(d).alias("key")) for d in DIMENSIONS])
    rows = manifest.select(F.inline(pairs), "row_idx").filter("key <> ''")
    counts = rows.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("count"), F.min("row_idx").alias("first_idx"))
    return ranked(counts, ["dimension", "key"], "dimension")
