"""Statistics of boxes (image, class_name, x, y, w, h, area) over a universe of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import bin_of, size_class

GRID, ORPHANS, TOP = 20, 100, 30


def per_image(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image and objects, 0 for images without boxes."""
    counts = boxes.groupBy("image").agg(F.count(F.lit(1)).alias("objects"))
    return images.select("image").join(counts, "image", "left").select("image", F.coalesce("objects", F.lit(0)).alias("objects"))


def stats(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """One row of totals."""
    by_image = per_image(boxes, images).agg(
        F.count(F.lit(1)).alias("total_images"), F.count_if(F.col("objects") > 0).alias("annotated_images"), F.count_if(F.col("objects") == 0).alias("unannotated_images"),
        F.coalesce(F.round(F.avg("objects"), 6), F.lit(0.0)).alias("mean_objects_per_image"), F.coalesce(F.max("objects"), F.lit(0)).alias("max_objects_per_image"),
    )
    classes = boxes.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_annotations"), F.count(F.lit(1)).alias("num_classes"))
    return by_image.withColumn("one", F.lit(1)).join(classes.withColumn("one", F.lit(1)), "one").drop("one")


def class_counts(boxes: DataFrame, top: int | None = None) -> DataFrame:
    """class_name, count, share of all boxes in percent, and rank."""
    counts = boxes.groupBy("class_name").agg(F.count(F.lit(1)).alias("count"))
    order = W.orderBy(F.desc("count"), "class_name")  # classes, not boxes
    out = counts.withColumn("rank", F.row_number().over(order)).withColumn("pct", F.round(F.col("count") * 100.0 / F.sum("count").over(W.partitionBy(F.lit(1))), 4))
    return out if top is None else out.filter(F.col("rank") <= top)


def size_classes(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(size_class(F.col("area")).alias("size_class")).agg(F.count(F.lit(1)).alias("count"))


def box_stats(boxes: DataFrame) -> DataFrame:
    """One row: means and ends of sizes; the aspect ratio over boxes with a height."""
    ratio = F.when(F.col("h") > 0, F.try_divide(F.col("w"), F.col("h")))

    def three(c, name: str):
        return [F.round(F.avg(c), 6).alias(f"mean_{name}"), F.round(F.min(c), 6).alias(f"min_{name}"), F.round(F.max(c), 6).alias(f"max_{name}")]

    return boxes.agg(*three(F.col("w"), "width"), *three(F.col("h"), "height"), *three(F.col("area"), "area"), *three(ratio, "aspect"), F.count(ratio).alias("with_height"))


def co_occurrence(boxes: DataFrame) -> DataFrame:
    """class_a, class_b and the images that hold both, for ordered pairs of different classes.

    An image's distinct classes are as many as there are classes at most, whatever its boxes.
    """
    own = boxes.select("image", "class_name").distinct()
    a, b = own.withColumnRenamed("class_name", "class_a"), own.withColumnRenamed("class_name", "class_b")
    return a.join(b, "image").filter("class_a <> class_b").groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("images"))


def objects_per_image(boxes: DataFrame, images: DataFrame) -> DataFrame:
    return per_image(boxes, images).groupBy("objects").agg(F.count(F.lit(1)).alias("images"))


def heatmap(boxes: DataFrame, n: int = GRID) -> DataFrame:
    """Box centres by cell of an n x n grid on [0, 1]; centres outside are ignored."""
    inside = boxes.filter("x between 0 and 1 and y between 0 and 1")
    return inside.groupBy(bin_of(F.col("x"), 0.0, 1.0, n).alias("cell_x"), bin_of(F.col("y"), 0.0, 1.0, n).alias("cell_y")).agg(F.count(F.lit(1)).alias("count"))


def orphans(boxes: DataFrame, images: DataFrame, limit: int | None = ORPHANS) -> DataFrame:
    """Annotated names without an image, sorted."""
    out = boxes.select("image").distinct().join(images.select("image"), "image", "left_anti")
    return out if limit is None else out.orderBy("image").limit(limit)


def unannotated(boxes: DataFrame, images: DataFrame) -> DataFrame:
    return images.select("image").join(boxes.select("image"), "image", "left_anti")


def split_class_counts(boxes: DataFrame, splits: DataFrame) -> DataFrame:
    """Boxes by split (image, split) and class."""
    return boxes.join(splits, "image").groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("count"))
