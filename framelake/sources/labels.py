"""Object labels as boxes: YOLO text, COCO JSON, VOC XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalised_box
from ..schema import BOXES

COCO = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"
VOC = "filename string, size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _text(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and text (null where it isn't UTF-8) of files; empty files are listed by ``names``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def names(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """image: stems of all files with a suffix, empty ones too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    it = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    found = set()
    while it.hasNext():
        name = it.next().getPath().getName()
        if name.endswith(suffix):
            found.add(name.removesuffix(suffix))
    return spark.createDataFrame([(n,) for n in sorted(found)], "image string")


def yolo(spark: SparkSession, root: str, class_names: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, images and failed files (image). Of a file, lines before the first bad one count; lines with
    fewer than five fields are skipped."""
    files = _text(spark, root, "*.txt").select(_stem(F.col("path")).alias("image"), "text")
    lines = files.filter("text is not null").select("image", F.posexplode(F.split(F.trim("text"), "\r\n|\n|\r")).alias("i", "line"))
    lines = lines.withColumn("p", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")).filter(F.size("p") >= 5)
    number = [F.try_element_at("p", F.lit(k)).try_cast("double") for k in range(2, 6)]
    lines = lines.withColumn("c", F.element_at("p", 1).try_cast("int"))
    good = F.col("c").isNotNull()
    for x in number:
        good = good & x.isNotNull()
    first_bad = lines.filter(~good).groupBy("image").agg(F.min("i").alias("bad"))
    kept = lines.join(first_bad, "image", "left").filter("bad is null or i < bad")
    n = len(class_names)
    listed = F.array(*map(F.lit, class_names)) if n else F.array().cast("array<string>")
    # A negative id counts from the end, as far as there are names.
    name = F.when((F.col("c") < n) & (F.col("c") >= -n), F.try_element_at(listed, F.when(F.col("c") >= 0, F.col("c") + 1).otherwise(F.col("c")))).otherwise(F.col("c").cast("string"))
    x, y, w, h = number
    boxes = kept.select("image", F.col("c").alias("class_id"), name.alias("class_name"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))
    failed = files.filter("text is null").select("image").union(first_bad.select("image"))
    return boxes.select([f.name for f in BOXES]), names(spark, root, ".txt"), failed


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, images (by file name; the last of an id wins) and categories. Boxes with fewer than four numbers
    and those of unknown images are left out; absent sizes count as 1."""
    doc = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(COCO).json(path)
    images = doc.select(F.posexplode("images").alias("k", "i")).select("k", "i.*").groupBy("id").agg(F.max(F.struct("k", "file_name", "width", "height")).alias("r"))
    images = images.select(F.col("id").alias("image_id"), F.col("r.file_name").alias("image"), F.coalesce("r.width", F.lit(1.0)).alias("iw"), F.coalesce("r.height", F.lit(1.0)).alias("ih"))
    categories = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), "name").dropDuplicates(["category_id"])
    rows = doc.select(F.inline("annotations")).filter("size(bbox) >= 4").join(images, "image_id").join(categories, "category_id", "left")
    box = normalised_box("coco", F.col("iw"), F.col("ih"), *[F.element_at("bbox", k) for k in range(1, 5)])
    boxes = rows.select("image", F.col("category_id").alias("class_id"), F.coalesce("name", F.col("category_id").cast("string")).alias("class_name"), *[c.alias(n) for n, c in box.items()])
    return boxes, images.filter("image is not null").select("image").distinct(), categories


def voc(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, images and failed files. The key is the file name given inside, else the file's stem; the last
    file of a key wins; objects without a box are left out; absent sizes count as 1."""
    files = _text(spark, root, "*.xml").select("path", _stem(F.col("path")).alias("stem"), F.from_xml("text", VOC).alias("a"))
    bad = F.col("a").isNull() | (F.col("a.filename").isNull() & F.col("a.size").isNull() & F.col("a.object").isNull())
    failed = files.filter(bad).select(F.col("stem").alias("image"))
    named = files.filter(~bad).select("path", F.coalesce(F.nullif(F.trim("a.filename"), F.lit("")), "stem").alias("image"), "a")
    last = named.groupBy("image").agg(F.max_by("a", "path").alias("a"))
    iw, ih = F.coalesce("a.size.width", F.lit(1.0)), F.coalesce("a.size.height", F.lit(1.0))
    rows = last.select("image", iw.alias("iw"), ih.alias("ih"), F.explode("a.object").alias("o")).filter("o.bndbox is not null")
    box = normalised_box("voc", F.col("iw"), F.col("ih"), *[F.coalesce(f"o.bndbox.{c}", F.lit(0.0)) for c in ("xmin", "ymin", "xmax", "ymax")])
    boxes = rows.select("image", F.lit(0).alias("class_id"), F.coalesce("o.name", F.lit("unknown")).alias("class_name"), *[c.alias(n) for n, c in box.items()])
    return boxes, last.select("image"), failed
