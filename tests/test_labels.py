import json

import pytest

from framelake.operators import annotations
from framelake.sources import formats, labels


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_yolo(spark, tmp_path):
    (tmp_path / "pier.txt").write_text("2 .31 .62 .07 .11\n0 .44 .13 .25 .375\n2 .9 .05 .02 .03\n")
    (tmp_path / "quay.txt").write_text("1 .75 .25 .125 .5")
    (tmp_path / "dusk.txt").write_text("")
    (tmp_path / "mole.txt").write_text("17 .6 .7 .08 .09\n1 .3\n-2 -.4 .2 .15 .35\nfour .2 .2 .2 .2\n2 .8 .8 .6 .6\n")
    (tmp_path / "wreck.txt").write_bytes(b"\xff\xfe\x00")
    boxes, images, failed = labels.yolo(spark, str(tmp_path), ["buoy", "crane", "ferry"])
    assert values(boxes, "image", "class_name") == [("mole", "17"), ("mole", "crane"), ("pier", "buoy"), ("pier", "ferry"), ("pier", "ferry"), ("quay", "crane")]
    assert values(failed, "image") == [("mole",), ("wreck",)]
    s = annotations.stats(boxes, images).first()
    assert (s["total_images"], s["annotated_images"], s["total_annotations"], s["max_objects_per_image"]) == (5, 3, 6, 3)


def test_coco(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text(
        json.dumps(
            {
                "images": [{"id": 31, "file_name": "lock.jpg", "width": 320, "height": 250}, {"id": 32, "file_name": "weir.jpg", "width": 0, "height": 0}, {"id": 33, "file_name": "ford.jpg"}],
                "annotations": [{"id": 5, "image_id": 31, "category_id": 8, "bbox": [80, 50, 160, 25]}, {"id": 6, "image_id": 32, "category_id": 13, "bbox": [7, 9, 3, 5]}, {"id": 7, "image_id": 31, "category_id": 8, "bbox": [4, 6, 2]}, {"id": 8, "image_id": 90, "category_id": 8, "bbox": [2, 2, 5, 5]}],
                "categories": [{"id": 8, "name": "barge"}],
            }
        )
    )
    boxes, images, _ = labels.coco(spark, str(p))
    assert values(boxes, "image", "class_name", "w", "h", "x") == [("lock.jpg", "barge", 0.5, 0.1, 0.5), ("weir.jpg", "13", 0.0, 0.0, 0.0)]
    assert values(annotations.unannotated(boxes, images), "image") == [("ford.jpg",)]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        labels.coco(spark, str(tmp_path / "bad.json"))[0].collect()


def test_voc(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>tide.jpg</filename><size><width>240</width><height>80</height></size><object><name>heron</name><bndbox><xmin>60</xmin><ymin>20</ymin><xmax>180</xmax><ymax>60</ymax></bndbox></object><object><name>gull</name></object></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><size><width>240</wid")
    (tmp_path / "c.xml").write_text("<annotation><object><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>1</xmax><ymax>1</ymax></bndbox></object></annotation>")
    boxes, images, failed = labels.voc(spark, str(tmp_path))
    assert values(boxes, "image", "class_name", "area") == [("c", "unknown", 1.0), ("tide.jpg", "heron", 0.25)]
    assert values(failed, "image") == [("b",)] and values(images, "image") == [("c",), ("tide.jpg",)]


def test_sizes_and_pairs(spark):
    rows = [("i", "a", 0.5, 0.5, 0.05, 0.05), ("i", "b", 1.0, 1.0, 0.2, 0.2), ("j", "a", 1.5, 0.2, 0.5, 0.5)]
    boxes = spark.createDataFrame([(*r, r[4] * r[5]) for r in rows], "image string, class_name string, x double, y double, w double, h double, area double")
    assert values(annotations.size_classes(boxes), "size_class", "count") == [("large", 1), ("medium", 1), ("small", 1)]
    assert values(annotations.co_occurrence(boxes), "class_a", "class_b", "images") == [("a", "b", 1), ("b", "a", 1)]
    assert values(annotations.heatmap(boxes), "cell_x", "cell_y") == [(10, 10), (19, 19)]
    images = spark.createDataFrame([("i",)], "image string")
    assert values(annotations.orphans(boxes, images), "image") == [("j",)]


def images(folder, n):
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(n):
        (folder / f"{i}.jpg").write_bytes(b"12345")


def test_detection(tmp_path):
    y = tmp_path / "yolo"
    images(y / "images" / "train", 5)
    images(y / "images" / "val", 2)
    (y / "data.yaml").write_text("names: [buoy, crane, ferry]\nnc: 3\n")
    got = formats.detect(str(y))
    assert (got.format, got.splits, got.class_names, got.num_images) == ("yolo", {"train": 5, "val": 2}, ["buoy", "crane", "ferry"], 7)
    assert [d.rsplit("/", 1)[1] for d in formats.selected_dirs(got, ["val"])] == ["val"]
    assert formats.selected_dirs(got, []) == formats.selected_dirs(got, ["other"]) == got.image_dirs
    c = tmp_path / "coco"
    images(c, 4)
    (c / "annotations").mkdir()
    (c / "annotations" / "boxes_val.json").write_text(json.dumps({"images": [7, 8, 9], "annotations": [], "categories": [{"id": 4, "name": "kelp"}, {"id": 6, "name": "reef"}]}))
    got = formats.detect(str(c))
    assert (got.format, got.splits, got.num_classes) == ("coco", {"val": 3}, 2)
    v = tmp_path / "voc"
    images(v / "JPEGImages", 3)
    (v / "Annotations").mkdir()
    (v / "Annotations" / "a.xml").write_text("<annotation/>")
    (v / "ImageSets" / "Main").mkdir(parents=True)
    (v / "ImageSets" / "Main" / "train.txt").write_text("tide\nsurf\nfoam\n\n")
    got = formats.detect(str(v))
    assert (got.format, got.splits) == ("voc", {"train": 3})
    k = tmp_path / "classes"
    for n in ("brick", "glass", "slate", "straw", "tin"):
        images(k / n, 2)
    got = formats.detect(str(k))
    assert (got.format, got.num_classes, got.num_images, got.size_bytes) == ("classification", 5, 10, 50)
    images(tmp_path / "flat", 2)
    assert formats.detect(str(tmp_path / "flat")).format == "flat"
    (tmp_path / "empty").mkdir()
    assert formats.detect(str(tmp_path / "empty")).num_images == 0
