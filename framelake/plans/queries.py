"""The registered queries: operators over the views of ``fixtures``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Policy
from ..functions import columns as fn
from ..operators import annotations, checks, diff, duplicates, embeddings, gate, leakage, plots, summary
from ..operators.graph import shared_root
from ..sources import manifest as files
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
POLICY = Policy(max_blurry_pct=50.0, max_artifact_pct=50.0, min_width=80, min_height=80, allowed_formats=("JPEG", "PNG"), max_aspect_ratio=3.0)
SIMILARITY, SAMPLE, BATCH = 0.35, 100, 20
#: What ``hamming_distance`` holds hashes against.
PROBE = "0123456789abcdef" * 4


def _manifest(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fx.manifest(spark, sf_dir))


def _pair(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*fx.old_and_new(spark, sf_dir))


def _boxes(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fx.boxes(spark, sf_dir))


def _boxes_images(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fx.boxes(spark, sf_dir), fx.images(spark, sf_dir))


def _vectors(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _splits(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fx.with_split(spark, sf_dir))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.manifest(spark, sf_dir)
    done = m.filter("row_idx % 3 = 0").withColumn("mtime", F.when(F.col("row_idx") % 6 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return diff.pending(m.select("path", "file_size_bytes", "mtime"), done)


def merge_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.manifest(spark, sf_dir)
    at = f"{shared_root(spark)}/merge/{uuid.uuid4().hex}"
    for k in range(3):
        files.write_jsonl(m.filter(F.col("row_idx") % 3 == k).drop("row_idx"), f"{at}/{k}", {"input_dir": "/"})
    # A torn line, a blank one, and records with values of other types than their columns'.
    odd = [('{"path": "torn', ), ("  ", ), ('{"path": "odd/a", "width": 640.0, "height": "480", "file_size_bytes": 7, "pixel_stats": 3}', ), ('{"path": "odd/b", "width": "wide", "more": [1]}', )]
    spark.createDataFrame(odd, "value string").coalesce(1).write.text(f"{at}/0/records/append=000000002")
    counts = files.merge_files(spark, [f"{at}/{k}" for k in range(4)], f"{at}/out", {})
    rows = files.read_jsonl(spark, f"{at}/out")[1]
    return rows.select("path", "file_size_bytes", "width", "height", *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("records", "skipped_lines", "missing_parts")])


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines with a header, a small append before and a large one after, read back: the last row of
    each path, all columns."""
    path = f"{shared_root(spark)}/roundtrip/{uuid.uuid4().hex}"
    m = fx.manifest(spark, sf_dir)
    files.write_jsonl(m.withColumn("width", F.lit(1)).drop("row_idx"), path, {"input_dir": "/", "settings": {}})
    files.append_jsonl(m.filter("row_idx % 10 = 0").withColumn("width", F.lit(2)).drop("row_idx"), path)
    files.append_jsonl(m.drop("row_idx"), path)
    files.append_jsonl(m.filter("row_idx % 50 = 0").withColumn("height", F.lit(3)).drop("row_idx"), path)
    _, records = files.read_jsonl(spark, path)
    rows = diff.latest_only(records)
    nested = [F.col(f"{s}.{f.name}").alias(f.name) for s in ("pixel_stats", "corner_stats") for f in rows.schema[s].dataType]
    return rows.select(*[c for c in rows.columns if c not in ("pixel_stats", "corner_stats", "analyzed_at", "analyzer_version", "row_idx")], *nested)


def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.manifest(spark, sf_dir).select("row_idx", "path")
    return files.batches(keys, BATCH).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def classification_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.manifest(spark, sf_dir)
    return m.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("folder")).agg(F.count(F.lit(1)).alias("images"))


def bbox_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pixels on images of 800 x 600, and of no size for every seventh order, by both rules."""
    b = fx.boxes(spark, sf_dir)
    iw, ih = F.when(F.col("image").cast("long") % 7 == 0, 0).otherwise(800), F.lit(600)
    a, t, w, h = (F.round(F.col(c) * s) for c, s in (("x", 400), ("y", 300), ("w", 200), ("h", 150)))
    coco, voc = fn.normalised_box("coco", iw, ih, a, t, w, h), fn.normalised_box("voc", iw, ih, a, t, a + w, t + h)
    out = b.select("image", *[F.round(c, 9).alias(f"coco_{k}") for k, c in coco.items()], *[F.round(c, 9).alias(f"voc_{k}") for k, c in voc.items()])
    return out.groupBy("image").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 8).alias(c) for c in out.columns[1:]])


def pixel_stats_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel statistics by the scan's kernel, on an image of synthetic pixels for each order."""
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *[F.floor(c).cast("double").alias(n) for n, c in (("r", F.col("l_quantity") * 5), ("g", F.col("l_discount") * 2000), ("b", F.col("l_tax") * 3000))])
    whole = p.groupBy("l_orderkey").agg(F.collect_list(F.struct("r", "g", "b")).alias("pixels"))  # an order has seven lines at most
    names = [f"{n}_{c}" for c in "rgb" for n in ("mean", "std")] + ["mean_brightness", "min_val", "max_val"]

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions import kernels

        for batch in batches:
            made = [kernels.pixel_stats(np.array([[[x["r"], x["g"], x["b"]]] for x in image], np.uint8)) for image in batch["pixels"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["l_orderkey"], *[pa.array([float(m[n]) for m in made], pa.float64()) for n in names]], names=["l_orderkey", *names])

    found = whole.mapInArrow(task, "l_orderkey long, " + ", ".join(f"{n} double" for n in names))
    return found.select("l_orderkey", *[F.round(n, 6).alias(n) for n in names])


QUERIES: dict[str, Query] = {
    "aggregate_summary": _manifest(summary.summary),
    **{f"{n}_counts": _manifest(lambda m, d=d: summary.category_counts(m, d)) for n, d in (("format", "format"), ("mode", "color_mode"), ("extension", "extension"), ("camera_make", "camera_make"), ("camera_model", "camera_model"))},
    "category_counts_grouping_sets": _manifest(summary.all_category_counts),
    "exif_summary": _manifest(summary.exif_summary),
    "check_corrupt": _manifest(checks.corrupt),
    "check_exposure": _manifest(checks.exposure),
    "check_artifacts": _manifest(checks.artifacts),
    "check_blur": _manifest(checks.blur),
    "check_all": _manifest(checks.everything),
    "report_flagged": _manifest(checks.flagged),
    "flag_thresholds": _manifest(lambda m: checks.flags(m).select("path", "is_dark", "is_overexposed", "has_border_artifact", "is_blurry")),
    "distortion_risk": _manifest(lambda m: m.select("path", fn.distortion_risk(F.col("focal_length_35mm")).alias("risk"))),
    "aspect_ratio": _manifest(lambda m: m.select("path", fn.aspect_ratio(F.col("width"), F.col("height")).alias("aspect_ratio"))),
    "fmt_bytes": _manifest(lambda m: m.select("path", fn.fmt_bytes(F.col("file_size_bytes") * F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("row_idx") % 3 + 1).cast("int"))).alias("size"))),
    "format_size": _manifest(lambda m: m.select("path", fn.format_size(F.col("width") * F.element_at(F.array(F.lit(0.0625), F.lit(1.0), F.lit(2048.0)), (F.col("row_idx") % 3 + 1).cast("int"))).alias("size"))),
    "exact_duplicates": _manifest(lambda m: duplicates.exact_groups(m).drop("first_idx")),
    "duplicate_count": _manifest(duplicates.duplicate_count),
    "duplicate_members": _manifest(duplicates.members),
    "plot_duplicates": _manifest(duplicates.group_sizes),
    "hamming_distance": _manifest(lambda m: m.select("path", fn.hamming(F.col("phash"), F.lit(PROBE)).alias("distance"))),
    "near_dup_pairs": _manifest(lambda m: duplicates.near_pairs(m).select("a", "b", "distance")),
    "near_dup_pairs_exact": _manifest(lambda m: duplicates.near_pairs(m, threshold=3, exact_recall=True).select("a", "b", "distance")),
    "near_dup_clusters": _manifest(duplicates.near_clusters),
    "near_dup_pairs_exact_8": _manifest(lambda m: duplicates.near_pairs(m, exact_recall=True).select("a", "b", "distance")),
    "near_dup_clusters_exact_8": _manifest(lambda m: duplicates.near_clusters(m, exact_recall=True)),
    "leakage_exact": _splits(leakage.exact),
    "leakage_near_pairs": _splits(lambda s: leakage.near_pairs(s, fx.SPLITS).select("split_a", "split_b", "path_a", "path_b", "distance")),
    "leakage_report": _splits(lambda s: leakage.report(s, fx.SPLITS)),
    "diff_added": _pair(diff.added),
    "diff_removed": _pair(diff.removed),
    "diff_status": _pair(diff.status),
    "diff_changes": _pair(diff.changes),
    "diff_summary": _pair(diff.summary),
    "latest_only": _pair(lambda old, new: diff.latest_only(old.unionByName(new)).select("path", "row_idx", "height")),
    "resume_pending": resume_pending,
    "merge_manifests": merge_manifests,
    "manifest_roundtrip": manifest_roundtrip,
    "gate_report": _manifest(lambda m: gate.report(m, POLICY)),
    "gate_samples": _manifest(gate.samples),
    "annotation_stats": _boxes_images(annotations.stats),
    "class_counts": _boxes(annotations.class_counts),
    "bbox_size_classes": _boxes(annotations.size_classes),
    "bbox_stats": _boxes(annotations.box_stats),
    "bbox_normalize": bbox_normalize,
    "co_occurrence": _boxes(annotations.co_occurrence),
    "objects_per_image": _boxes_images(annotations.objects_per_image),
    "bbox_heatmap": _boxes(annotations.heatmap),
    "orphan_annotations": _boxes_images(lambda b, i: annotations.orphans(b, i.filter(F.col("image").cast("long") % 10 != 0))),
    "unannotated_images": _boxes_images(annotations.unannotated),
    "split_class_counts": _boxes_images(lambda b, i: annotations.split_class_counts(b, i.select("image", F.when(F.col("image").cast("long") % 5 == 0, "val").otherwise("train").alias("split")))),
    "embedding_norms": _vectors(embeddings.norms),
    "embedding_centroid": _vectors(lambda v: embeddings.centroid(v).select("pos", F.round("value", 6).alias("value"))),
    "embedding_outliers": _vectors(lambda v: embeddings.outliers(v).select("vec_id", F.round("similarity", 6).alias("similarity"))),
    "semantic_duplicates": _vectors(lambda v: embeddings.semantic_pairs(v, SIMILARITY).select("a", "b", F.round("similarity", 6).alias("similarity"))),
    "file_size_percentiles": _manifest(lambda m: plots.file_size_percentiles(m).select(*[F.round(c, 6).alias(c) for c in ("median_kb", "p95_kb", "p99_kb")])),
    "file_size_hist": _manifest(plots.file_size_histogram),
    "plot_dimensions": _manifest(plots.dimensions),
    "plot_aspect_ratio": _manifest(plots.aspect_ratio),
    "plot_brightness": _manifest(plots.brightness),
    "plot_channels": _manifest(lambda m: plots.channels(m).select("channel", *[F.round(c, 6).alias(c) for c in ("low", "mean", "median", "high")])),
    "plot_artifacts": _manifest(plots.artifacts),
    "plot_blur": _manifest(plots.blur),
    "plot_exif_camera": _manifest(plots.exif_camera),
    "plot_exif_focal": _manifest(plots.exif_focal),
    "plot_exif_zones": _manifest(plots.focal_zones),
    "plot_exif_iso": _manifest(plots.exif_iso),
    "flatten_csv": _manifest(lambda m: files.flat_csv(files.conformed(m))),
    "flatten_parquet": _manifest(lambda m: (flat := files.flat_parquet(files.conformed(m))).toDF(*[c.replace(".", "_") for c in flat.columns])),
    "sample_n": _manifest(lambda m: plots.prepared(m, SAMPLE).select("path")),
    "batch_chunks": batch_chunks,
    "size_estimate": _manifest(files.size_estimate),
    "classification_split_counts": classification_split_counts,
    "pixel_stats_sql": pixel_stats_sql,
}
