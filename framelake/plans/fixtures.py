"""Views with the manifest, box and split schemas over the synthetic tables, for Spark and for SQL.

The tables hold no images, so columns come from digests of the texts; both dialects give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.columns import aspect_ratio, distortion_risk
from ..operators.checks import flags

#: A text's ``phash`` has 64 digits, as a scan's hashes have: for each of these characters, common and rare ones in
#: turn, how often the whole text has it, in steps of ``STEP``, as a digit of which neighbours differ in one bit.
COUNTED = "etdgfpy048D?$äéínauo,vx159A-%öèóislm.kj26TS|&üêúrhcbwzq37E!#*ßáñ"
STEP, GRAY = 2, "01326754cdfeab98"
#: The same characters, common ones first, after the space.
FIRST = " " + "".join(sorted(COUNTED, key=lambda c: ("enartiosludcmhgpbfvkwzyjqxäöüßéèêíóáúñ,.".find(c) % 99, c)))


def phash(text: Column) -> Column:
    """The digits of ``COUNTED``. Each character is taken out in turn, so the next one searches less text; its number is the
    length lost. The last step only takes the last length."""
    gone = F.aggregate(
        F.array(*map(F.lit, FIRST + " ")),
        F.struct(text.alias("t"), F.array().cast("array<int>").alias("n")),
        lambda s, c: F.struct(F.replace(s["t"], c, F.lit("")).alias("t"), F.concat(s["n"], F.array(F.length(s["t"]))).alias("n")),
        lambda s: F.transform(
            F.array(*[F.lit(FIRST.index(c)) for c in COUNTED]),
            lambda k: F.substr(F.lit(GRAY), (F.floor((s["n"][k] - s["n"][k + 1]) / STEP) % 16 + 1).cast("int"), F.lit(1)),
        ),
    )
    return F.array_join(gone, "")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").alias("row_idx"), "lang", "source", F.col("n_chars").alias("file_size_bytes"), F.md5(text).alias("m"),
        phash(text).alias("phash"),
    )

    def b(k: int):
        return F.conv(F.substring("m", 2 * k - 1, 2), 16, 10).cast("int")

    ext = F.element_at(F.array(*map(F.lit, ("jpg", "JPEG", "png", "webp"))), (F.col("row_idx") % 4 + 1).cast("int"))
    name = F.concat(F.col("row_idx").cast("string"), F.lit("."), ext)
    camera, some = b(8) % 6, b(8) % 6 < 3
    width, height = 64 + b(1) * 16, 64 + b(2) * 12
    zero = F.lit(0.0)
    rows = base.select(
        "row_idx",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        name.alias("filename"),
        "file_size_bytes",
        (F.col("row_idx") * 1.0).alias("mtime"),
        width.alias("width"), height.alias("height"),
        F.when(F.col("row_idx") % 4 == 2, "PNG").when(F.col("row_idx") % 4 == 3, "WEBP").otherwise("JPEG").alias("format"),
        F.when(b(3) % 5 == 0, "L").otherwise("RGB").alias("color_mode"),
        F.when(b(3) % 5 == 0, 1).otherwise(3).alias("num_channels"),
        aspect_ratio(width, height).alias("aspect_ratio"),
        F.when(camera == 0, "Canon").when(camera == 1, "Nikon").when(camera == 2, "Sony").alias("camera_make"),
        F.when(camera == 0, "Canon EOS 5D").when(camera == 1, "D850").when(camera == 2, "A7III").alias("camera_model"),
        F.when(some, 10 + b(9) % 90).alias("focal_length_35mm"),
        F.when(some, 100 * (1 + b(10) % 64)).alias("iso_speed"),
        F.when(some, 1 + b(11) % 8).alias("orientation_tag"),
        (b(12) % 11 == 0).alias("has_gps_data"),
        F.struct(b(4).cast("double").alias("mean_r"), b(13).cast("double").alias("mean_g"), b(14).cast("double").alias("mean_b"), zero.alias("std_r"), zero.alias("std_g"), zero.alias("std_b"), b(3).cast("double").alias("mean_brightness"), F.lit(0).alias("min_val"), F.lit(255).alias("max_val")).alias("pixel_stats"),
        F.struct(zero.alias("corner_mean"), zero.alias("center_mean"), zero.alias("border_mean"), (b(5) / 2.0).alias("delta")).alias("corner_stats"),
        "phash",
        (b(6) * b(7) / 100.0).alias("blur_score"),
        (b(15) < 6).alias("is_corrupt"),
    )
    return flags(rows, ScanConfig()).withColumn("distortion_risk", distortion_risk(F.col("focal_length_35mm")))


def _b(k: int) -> str:
    return f"(('0x' || substr(m, {2 * k - 1}, 2))::int)"


#: The same view in SQL.
MANIFEST_SQL = f"""base as (select doc_id as row_idx, lang, source, n_chars as file_size_bytes, md5(coalesce(text, '')) as m,
    {" || ".join(f"substr('{GRAY}', (length(t) - length(replace(t, '{c.replace(chr(39), chr(39) * 2)}', ''))) // {STEP} % 16 + 1, 1)" for c in COUNTED)} as phash
    from (select *, coalesce(text, '') as t from documents)),
  wide as (select row_idx, row_idx::varchar || '.' || case row_idx % 4 when 0 then 'jpg' when 1 then 'JPEG' when 2 then 'png' else 'webp' end as filename,
    source, lang, file_size_bytes, row_idx::double as mtime, 64 + {_b(1)} * 16 as width, 64 + {_b(2)} * 12 as height,
    case row_idx % 4 when 2 then 'PNG' when 3 then 'WEBP' else 'JPEG' end as format,
    case when {_b(3)} % 5 = 0 then 'L' else 'RGB' end as color_mode, case when {_b(3)} % 5 = 0 then 1 else 3 end as num_channels,
    case {_b(8)} % 6 when 0 then 'Canon' when 1 then 'Nikon' when 2 then 'Sony' end as camera_make,
    case {_b(8)} % 6 when 0 then 'Canon EOS 5D' when 1 then 'D850' when 2 then 'A7III' end as camera_model,
    case when {_b(8)} % 6 < 3 then 10 + {_b(9)} % 90 end as focal_length_35mm,
    case when {_b(8)} % 6 < 3 then 100 * (1 + {_b(10)} % 64) end as iso_speed,
    case when {_b(8)} % 6 < 3 then 1 + {_b(11)} % 8 end as orientation_tag,
    {_b(12)} % 11 = 0 as has_gps_data, {_b(4)}::double as mean_r, {_b(13)}::double as mean_g, {_b(14)}::double as mean_b, {_b(3)}::double as mean_brightness,
    {_b(5)} / 2.0::double as delta, phash, {_b(6)} * {_b(7)} / 100.0::double as blur_score, {_b(15)} < 6 as is_corrupt from base),
  manifest as (select *, '/' || source || '/' || lang || '/' || filename as path, round(width::double / height, 4) as aspect_ratio,
    mean_brightness < 40 as is_dark, mean_brightness > 220 as is_overexposed, delta > 50 as has_border_artifact, blur_score < 100 as is_blurry,
    case when focal_length_35mm < 18 then 'high' when focal_length_35mm < 24 then 'medium' when focal_length_35mm is not null then 'low' end as distortion_risk from wide),
  valid as (select * from manifest where not is_corrupt), hashable as (select * from valid where phash <> '')"""


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = manifest(spark, sf_dir)
    return m.filter("row_idx % 10 <> 0"), m.filter("row_idx % 10 <> 1").withColumn("width", F.when(F.col("row_idx") % 7 == 0, F.col("width") + 1).otherwise(F.col("width")))


OLD_NEW_SQL = MANIFEST_SQL + """,
  old as (select * from manifest where row_idx % 10 <> 0),
  new as (select * replace (case when row_idx % 7 = 0 then width + 1 else width end as width) from manifest where row_idx % 10 <> 1)"""

SPLITS = ("train", "val", "test")


def with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("row_idx") % 10
    return manifest(spark, sf_dir).withColumn("split", F.when(d < 7, "train").when(d < 9, "val").otherwise("test"))


SPLIT_SQL = MANIFEST_SQL + """,
  s as (select *, case when row_idx % 10 < 7 then 'train' when row_idx % 10 < 9 then 'val' else 'test' end as split from manifest)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("class_name"))
    w, h = F.col("l_discount") * 5, F.col("l_tax") * 5
    return items.join(parts, "l_partkey").select(F.col("l_orderkey").cast("string").alias("image"), "class_name", (F.col("l_quantity") / 50).alias("x"), (F.col("l_linenumber") / 8).alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("image"))


BOXES_SQL = """boxes as (select l_orderkey::varchar as image, p_type as class_name, l_quantity / 50 as x, l_linenumber / 8 as y, l_discount * 5 as w, l_tax * 5 as h,
    (l_discount * 5) * (l_tax * 5) as area from lineitem join part on l_partkey = p_partkey),
  images as (select o_orderkey::varchar as image from orders),
  per_image as (select i.image, count(b.image) as objects from images i left join boxes b using (image) group by i.image)"""
