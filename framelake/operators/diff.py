"""Differences of two manifests by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .duplicates import exact_groups

FIELDS = ("file_size_bytes", "width", "height", "format", "color_mode", "is_corrupt", "is_dark", "is_overexposed", "has_border_artifact", "phash")


def latest_only(manifest: DataFrame) -> DataFrame:
    """The last row of each path; partial maxima meet before the shuffle."""
    others = [c for c in manifest.columns if c not in ("path", "row_idx")]
    return manifest.groupBy("path").agg(F.max(F.struct("row_idx", *others)).alias("r")).select("path", "r.*").select(manifest.columns)


def _fields(manifest: DataFrame) -> DataFrame:
    last = manifest.groupBy("path").agg(F.max(F.struct("row_idx", *FIELDS)).alias("r"))
    return last.select("path", F.struct(*[F.col(f"r.{f}").alias(f) for f in FIELDS]).alias("r"))


def joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, removed, changed, unchanged) and changes (field, old, new as text)."""
    a, b = _fields(old).withColumnRenamed("r", "o"), _fields(new).withColumnRenamed("r", "n")
    both = a.join(b, "path", "full_outer")
    changes = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new"))) for f in FIELDS]))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    both = both.withColumn("changes", changes).withColumn("status", status)
    return both.select("path", "status", F.when(F.col("status") == "changed", F.col("changes")).alias("changes"))


def status(old: DataFrame, new: DataFrame) -> DataFrame:
    return joined(old, new).select("path", "status")


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("path").distinct().join(old.select("path"), "path", "left_anti")


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return added(new, old)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, field, old and new of each changed field."""
    return joined(old, new).filter("status = 'changed'").select("path", F.inline("changes"))


def summary(old: DataFrame, new: DataFrame) -> DataFrame:
    counts = joined(old, new).agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("added", "removed", "changed", "unchanged")])
    tables = [counts]
    for name, m in (("old", old), ("new", new)):
        tables.append(m.agg(F.count(F.lit(1)).alias(f"total_{name}"), F.count_if("is_corrupt").alias(f"corrupt_{name}")))
        tables.append(exact_groups(m).agg(F.count(F.lit(1)).alias(f"duplicate_groups_{name}")))
    out = tables[0].withColumn("one", F.lit(1))
    for t in tables[1:]:  # one row each
        out = out.join(t.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def pending(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files (path, file_size_bytes, mtime) that no manifest row has with equal size and time."""
    return listing.join(manifest.select("path", "file_size_bytes", "mtime"), ["path", "file_size_bytes", "mtime"], "left_anti")
