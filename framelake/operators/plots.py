"""The data behind each plot: bins and counts, never raw points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import adaptive_bins, bin_of, camera_label
from .statistics import ends, histogram, percentiles
from .summary import ranked

# Zones and marks of the plots.
DARK, BRIGHT, BLURRY, NOISY, DELTA = 40.0, 220.0, 100.0, 3200, 50.0
FOCAL_ZONES = ((0, 24, "Ultra-wide"), (24, 35, "Wide"), (35, 70, "Normal"), (70, 200, "Telephoto"))
SCATTER, CELLS = 5000, 50


def valid(manifest: DataFrame) -> DataFrame:
    return manifest.filter("not is_corrupt")


def sample_n(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: those with the least seeded digest of the path."""
    return rows.orderBy(F.md5(F.concat(F.col("path"), F.lit(str(seed)))), "path").limit(n)


def prepared(manifest: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    rows = valid(manifest)
    return rows if sample is None else sample_n(rows, sample, seed)


def file_size_percentiles(manifest: DataFrame) -> DataFrame:
    rows = valid(manifest).select((F.col("file_size_bytes") / 1024.0).alias("kb"))
    median, p95, p99 = percentiles(rows, "kb", [0.5, 0.95, 0.99])
    return manifest.sparkSession.createDataFrame([(median, p95, p99)], "median_kb double, p95_kb double, p99_kb double")


def file_size_histogram(manifest: DataFrame) -> DataFrame:
    """Log-spaced bins between the least (0.1 KB at least) and the largest size."""
    rows = valid(manifest).select((F.col("file_size_bytes") / 1024.0).alias("kb"))
    n, low, high = ends(rows, "kb")
    low = max(low, 0.1)
    high = max(high, low)
    bins = adaptive_bins(n, low, high) - 1
    logs = rows.filter(F.col("kb") >= low).select(F.log10("kb").alias("v"))
    return histogram(logs, "v", bins, math.log10(low), math.log10(high)).select("bin", "count")


def dimensions(manifest: DataFrame) -> DataFrame:
    """Sizes with their counts while there are few rows, else counts on a grid: x, y, count."""
    rows = valid(manifest)
    n, wl, wh = ends(rows, "width")
    if n <= SCATTER:
        return rows.groupBy(F.col("width").alias("x"), F.col("height").alias("y")).agg(F.count(F.lit(1)).alias("count"))
    _, hl, hh = ends(rows, "height")
    return rows.groupBy(bin_of(F.col("width"), wl, wh, CELLS).alias("x"), bin_of(F.col("height"), hl, hh, CELLS).alias("y")).agg(F.count(F.lit(1)).alias("count"))


def aspect_ratio(manifest: DataFrame) -> DataFrame:
    rows = valid(manifest).filter("aspect_ratio > 0")
    n, low, high = ends(rows, "aspect_ratio")
    return histogram(rows, "aspect_ratio", min(60, max(20, n // 5)), low, high).select("bin", "count")


def brightness(manifest: DataFrame) -> DataFrame:
    """60 bins, with the zone of each bin's begin."""
    rows = valid(manifest).filter("pixel_stats is not null").select(F.col("pixel_stats.mean_brightness").alias("v"))
    return histogram(rows, "v", 60).select("bin", "count", F.when(F.col("bin_low") < DARK, "dark").when(F.col("bin_low") > BRIGHT, "overexposed").otherwise("normal").alias("zone"))


def channels(manifest: DataFrame) -> DataFrame:
    """channel, least, mean, median and largest value."""
    rows = valid(manifest).filter("pixel_stats is not null").select(*[F.col(f"pixel_stats.mean_{c}").alias(c) for c in "rgb"])
    s = rows.agg(*[f(c) for c in "rgb" for f in (F.min, F.avg, F.max)]).first()
    out = [(c, s[3 * i], s[3 * i + 1], percentiles(rows, c, [0.5])[0], s[3 * i + 2]) for i, c in enumerate("rgb")]
    return manifest.sparkSession.createDataFrame(out, "channel string, low double, mean double, median double, high double")


def artifacts(manifest: DataFrame, threshold: float = DELTA) -> DataFrame:
    rows = valid(manifest).filter("corner_stats is not null").select(F.col("corner_stats.delta").alias("v"))
    _, low, high = ends(rows, "v")
    over = rows.groupBy(bin_of(F.col("v"), low, high, 60).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("v") > threshold).alias("over"))
    return over


def blur(manifest: DataFrame) -> DataFrame:
    rows = valid(manifest).filter("blur_score is not null")
    _, low, high = ends(rows, "blur_score")
    return rows.groupBy(bin_of(F.col("blur_score"), low, high, 80).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("blur_score") < BLURRY).alias("blurry"))


def exif_camera(manifest: DataFrame, top: int = 15) -> DataFrame:
    rows = valid(manifest).select(camera_label(F.col("camera_make"), F.col("camera_model")).alias("camera"), "row_idx").filter("camera is not null")
    counts = rows.groupBy("camera").agg(F.count(F.lit(1)).alias("count"), F.min("row_idx").alias("first_idx"))
    return ranked(counts.orderBy(F.desc("count"), "first_idx").limit(top), ["camera"])


def exif_focal(manifest: DataFrame) -> DataFrame:
    rows = valid(manifest).filter("focal_length_35mm > 0")
    _, low, high = ends(rows, "focal_length_35mm")
    return histogram(rows, "focal_length_35mm", 50, low, high).select("bin", "count")


def focal_zones(manifest: DataFrame) -> DataFrame:
    f = F.col("focal_length_35mm")
    zone = F.lit("Super-telephoto")
    for low, high, name in reversed(FOCAL_ZONES):
        zone = F.when((f >= low) & (f < high), name).otherwise(zone)
    return valid(manifest).filter("focal_length_35mm > 0").groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("count"))


def exif_iso(manifest: DataFrame) -> DataFrame:
    rows = valid(manifest).filter("iso_speed > 0")
    _, low, high = ends(rows, "iso_speed")
    return rows.groupBy(bin_of(F.col("iso_speed"), low, high, 50).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("iso_speed") >= NOISY).alias("high_noise"))
