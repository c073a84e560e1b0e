"""Image folders as manifests.

The listing is the spine: a row for each file, also for those that Spark's image source drops or can't decode.
Only files that are pending are opened. Their headers come from one source and their pixels from Spark's decoder, each
reduced to a small row in the task that read the file; only such rows are joined, so neither bytes nor pixels are
shuffled. What the settings don't ask for isn't computed, and without pixel columns nothing is decoded.
"""

from __future__ import annotations

import os
import re
import signal
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScanConfig
from ..functions.columns import distortion_risk
from ..operators.checks import flags
from ..operators.graph import cut
from ..operators.diff import pending
from ..schema import MANIFEST
from . import manifest as files

LISTING = "path string, filename string, file_size_bytes bigint, mtime double"


def discover(root: str, extensions: tuple[str, ...] = ScanConfig().extensions) -> list[str]:
    """Files below ``root`` with one of the extensions, sorted; links to folders aren't followed."""
    found = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.lower().endswith(tuple(e.lower() for e in extensions))]
    return sorted(found)


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = ScanConfig().extensions) -> DataFrame:
    """path, filename, size and time of a local folder, from the driver; sees hidden and empty files."""
    rows = []
    for p in discover(root, extensions):
        try:
            s = os.stat(p)
            rows.append((p, os.path.basename(p), s.st_size, s.st_mtime))
        except OSError:
            rows.append((p, os.path.basename(p), 0, 0.0))
    return spark.createDataFrame(rows, LISTING)


def distributed_listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = ScanConfig().extensions) -> DataFrame:
    """The same from Spark's file source, for stores with many files; hidden and empty files are missing, and
    times have milliseconds."""
    ends = "|".join(re.escape(e.lower()) for e in extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.filter(F.lower("path").rlike(f"({ends})$")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size_bytes"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"))


_NAMES = ("pixel_stats", "corner_stats", "phash", "dhash", "blur_score")
#: What is read from a file's head, and from its pixels.
HEAD = T.StructType([f for f in MANIFEST if f.name not in (*_NAMES, "filename", "file_size_bytes", "mtime", "aspect_ratio", "distortion_risk", "is_blurry", "is_dark", "is_overexposed", "has_border_artifact", "analyzed_at", "analyzer_version")])
PIXELS = T.StructType([MANIFEST["path"], T.StructField("decoded", T.BooleanType()), T.StructField("failed", T.BooleanType()), *[MANIFEST[n] for n in _NAMES]])
#: Images of an Arrow batch: their pixels bound a worker's memory.
TOGETHER = 16


@contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Raise TimeoutError in what runs longer; without effect outside of a process's main thread."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_) -> None:
        raise TimeoutError(f"took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _each(rows: DataFrame, one, schema: T.StructType) -> DataFrame:
    """``one(row of a batch, place in it)`` for each row, as ``schema``."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            made = [one(batch, k) for k in range(batch.num_rows)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in made], f.type) for f in target], schema=target)

    return rows.mapInArrow(task, schema)


def analysed(contents: DataFrame, config: ScanConfig) -> DataFrame:
    """Header and EXIF columns (``HEAD``) of rows (path, content). Failures make a row corrupt and keep what was
    found before."""

    def one(batch, k: int) -> dict:
        from ..functions import kernels

        row: dict = {"path": batch["path"][k].as_py(), "has_gps_data": False, "is_corrupt": False, "width": 0, "height": 0, "format": "", "color_mode": "", "num_channels": 0}
        try:
            with limited(config.image_timeout):
                data = batch["content"][k].as_py() or b""
                head = kernels.header(data)
                if not head:
                    raise ValueError("no image")
                row |= head
                if not config.skip_exif:
                    row |= {n: v for n, v in kernels.exif(data).items() if v is not None}
        except Exception:  # noqa: BLE001 any failure marks the row
            row["is_corrupt"] = True
        return row

    return _each(contents, one, HEAD)


def reduced(images: DataFrame, config: ScanConfig) -> DataFrame:
    """Statistics and hashes (``PIXELS``) of rows (path, image), the image as Spark decodes it."""

    def one(batch, k: int) -> dict:
        from ..functions import kernels

        row: dict = {"path": batch["path"][k].as_py(), "decoded": False, "failed": False}
        try:
            with limited(config.image_timeout):
                image = batch["image"][k].as_py()
                if image is None or image["width"] <= 0:
                    return row
                row["decoded"] = True
                rgb = kernels.bounded(kernels.rgb_of(image["height"], image["width"], image["nChannels"], image["data"]), config.max_image_dimension)
                if not config.skip_pixel_stats:
                    row["pixel_stats"], row["corner_stats"] = kernels.pixel_stats(rgb), kernels.corner_stats(rgb)
                if not config.skip_blur:
                    row["blur_score"] = kernels.blur_score(rgb)
                if config.include_hashes:
                    row["phash"], row["dhash"] = kernels.phash(rgb, config.hash_size), kernels.dhash(rgb, config.hash_size)
        except Exception:  # noqa: BLE001
            row["failed"] = True
        return row

    return _each(images, one, PIXELS)


def finished(rows: DataFrame, config: ScanConfig) -> DataFrame:
    """The columns that follow from others; absent pixel columns are null."""
    rows = rows.withColumns({n: F.lit(None).cast(MANIFEST[n].dataType) for n in _NAMES if n not in rows.columns})
    ratio = F.when(F.col("height") > 0, F.round(F.col("width") / F.col("height"), 4)).otherwise(F.lit(0.0))
    rows = flags(rows.withColumn("aspect_ratio", ratio), config)
    return rows.withColumn("blur_score", F.round("blur_score", 2)).withColumn("distortion_risk", distortion_risk(F.col("focal_length_35mm")))


def _normal(path: Column) -> Column:
    """A path without scheme, as the listing has it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _source(spark: SparkSession, kind: str, paths: Iterable[str], **options: str) -> DataFrame:
    """Files by name; characters that a pattern would use stand for themselves."""
    return spark.read.format(kind).options(recursiveFileLookup="true", ignoreMissingFiles="true", **options).load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])


def analysed_files(spark: SparkSession, listed: DataFrame, paths: list[str], config: ScanConfig) -> DataFrame:
    """A manifest of the files of ``listed`` (path, filename, size and time), which are read from ``paths``."""
    heads = analysed(_source(spark, "binaryFile", paths).select(_normal(F.col("path")).alias("path"), "content"), config) if paths else spark.createDataFrame([], HEAD)
    out = listed.join(heads, "path", "left")
    corrupt = F.coalesce("is_corrupt", F.lit(True))
    if not paths:
        out = out.withColumn("is_corrupt", corrupt)
    elif not config.skip_pixel_stats or not config.skip_blur or config.include_hashes:
        images = _source(spark, "image", paths, dropInvalid="false").select(_normal(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))).alias("path"), "image")  # a URI
        out = out.join(reduced(images, config), "path", "left")
        undecoded = ~F.coalesce("decoded", F.lit(False)) & ~F.coalesce(F.col("format") == "WEBP", F.lit(False))  # there is no reader of that format
        out = out.withColumns({n: F.when(~corrupt, F.col(n)) for n in _NAMES}).withColumn("is_corrupt", corrupt | undecoded | F.coalesce("failed", F.lit(False))).drop("decoded", "failed")
    else:
        out = out.withColumn("is_corrupt", corrupt)
    out = finished(out, config).withColumns({"analyzed_at": F.lit(datetime.now(UTC).isoformat()), "analyzer_version": F.lit("1")})
    return files.conformed(out)


def pending_files(spark: SparkSession, root: str, config: ScanConfig, existing: DataFrame | None = None) -> list[tuple]:
    """Listed files that ``existing`` doesn't have with equal size and time; by path. The listing is the driver's."""
    listed = listing(spark, root, config.extensions)
    if existing is not None and config.resume and not config.force:
        listed = listed.join(pending(listed.select("path", "file_size_bytes", "mtime"), existing).select("path"), "path", "left_semi")
    return sorted(tuple(r) for r in listed.collect())


def scan(spark: SparkSession, root: str, config: ScanConfig = ScanConfig(), existing: DataFrame | None = None) -> DataFrame:
    """A manifest of the images below ``root`` that ``existing`` doesn't have with equal size and time."""
    found = pending_files(spark, root, config, existing)
    if not found:
        return files.conformed(spark.createDataFrame([], MANIFEST))
    return analysed_files(spark, spark.createDataFrame(found, LISTING), [r[0] for r in found], config)


def scan_keys(spark: SparkSession, keys: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """A manifest of the files named, in any store that Spark reads; those it doesn't list are corrupt."""
    there = [k for k in keys if files.exists(spark, k)]
    found = _source(spark, "binaryFile", there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")
    held = found.select(_normal(F.col("path")).alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000.0).alias("time"))
    named = spark.createDataFrame([(k,) for k in keys], "key string").select(_normal(F.col("key")).alias("path"))
    listed = named.join(held, "path", "left").select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.coalesce("size", F.lit(0)).cast("bigint").alias("file_size_bytes"), F.coalesce("time", F.lit(0.0)).alias("mtime"))
    return analysed_files(spark, listed, there, config)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows to an Arrow batch; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TOGETHER))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_scan(spark: SparkSession, root: str, output: str, config: ScanConfig = ScanConfig()) -> tuple[int, int]:
    """Scan a folder into the JSON-lines manifest at ``output``; returns its rows and the corrupt ones of this
    run. Rows known from before are kept, a changed file is appended again. Without images nothing is written.

    Files are analysed and appended in turns of ``checkpoint_every`` for each core, so a run that breaks off loses one
    turn at most and the next resumes after it.
    """
    with small_batches(spark):
        if not discover(root, config.extensions):
            return 0, 0
        resume = config.resume and not config.force and files.exists(spark, output)
        existing = files.read_jsonl(spark, output)[1] if resume else None
        before = existing.count() if existing is not None else 0
        found = pending_files(spark, root, config, existing)
        settings = {"input_dir": root, "settings": {k: str(v) for k, v in config.asdict().items()}}
        if not resume:
            files.write_jsonl(spark.createDataFrame([], MANIFEST), output, settings)
        turn = max(1, config.checkpoint_every) * max(1, spark.sparkContext.defaultParallelism)
        done = bad = 0
        for at in range(0, len(found), turn):
            some = found[at : at + turn]
            made = cut(analysed_files(spark, spark.createDataFrame(some, LISTING), [r[0] for r in some], config))
            files.append_jsonl(made.orderBy("path"), output)
            done, bad = done + len(some), bad + made.filter("is_corrupt").count()
        files.write_meta(spark, output, settings | {"total_files": before + done})
        return before + done, bad
