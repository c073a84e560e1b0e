import json
import shutil
import struct
import time
import zlib

import numpy as np
import pytest

from framelake import cli
from framelake.config import PlotConfig, Policy, ScanConfig
from framelake.engine import Engine, handle, run_jobs
from framelake.functions import kernels
from framelake.sources import images
from framelake.streaming import incremental


def png(rgb):
    h, w = rgb.shape[:2]
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def exif_jpeg():
    """A JPEG head with an EXIF block: two text tags, an orientation, and a sub-directory."""
    make, model, lens = b"Canon\x00", b"Canon EOS 5D Mark IV\x00", b"Canon EF 14mm f/2.8L II USM\x00"
    first, second = 4, 6
    at = 8
    sub = at + 2 + 12 * first + 4
    data = sub + 2 + 12 * second + 4
    blobs, place = b"", data

    def blob(b):
        nonlocal blobs, place
        where = place
        blobs += b
        place += len(b)
        return where

    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack("<I", value))

    ifd0 = struct.pack("<H", first) + entry(0x010F, 2, len(make), blob(make)) + entry(0x0110, 2, len(model), blob(model)) + entry(0x0112, 3, 1, struct.pack("<HH", 6, 0)) + entry(0x8769, 4, 1, sub) + struct.pack("<I", 0)
    ifd1 = struct.pack("<H", second) + entry(0x829A, 5, 1, blob(struct.pack("<II", 1, 1000))) + entry(0x829D, 5, 1, blob(struct.pack("<II", 28, 10))) + entry(0x8827, 3, 1, struct.pack("<HH", 400, 0)) + entry(0x920A, 5, 1, blob(struct.pack("<II", 14, 1))) + entry(0xA405, 3, 1, struct.pack("<HH", 14, 0)) + entry(0xA434, 2, len(lens), blob(lens)) + struct.pack("<I", 0)
    tiff = b"II*\x00" + struct.pack("<I", 8) + ifd0 + ifd1 + blobs
    body = b"Exif\x00\x00" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 480, 640, 3) + bytes(10)


def test_exif():
    got = kernels.exif(exif_jpeg())
    assert got["camera_make"] == "Canon" and got["camera_model"] == "Canon EOS 5D Mark IV" and got["lens_model"] == "Canon EF 14mm f/2.8L II USM"
    assert got["orientation_tag"] == 6 and got["iso_speed"] == 400 and got["focal_length_35mm"] == 14
    assert got["exposure_time_sec"] == pytest.approx(0.001) and got["f_number"] == pytest.approx(2.8) and not got["has_gps_data"]
    assert kernels.exif(b"\xff\xd8\xff\xd9") == {} and kernels.exif(exif_jpeg()[:60]) is not None


def test_headers():
    assert kernels.header(exif_jpeg()) == {"format": "JPEG", "width": 640, "height": 480, "color_mode": "RGB", "num_channels": 3}
    assert kernels.header(png(np.zeros((3, 5, 3), np.uint8)))["width"] == 5
    assert kernels.header(b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(9))["height"] == 9
    assert kernels.header(b"not a real image file content") == {} and kernels.header(b"") == {}


def test_kernels_on_closed_forms():
    flat = np.full((100, 100, 3), 128, np.uint8)
    board = np.indices((100, 100)).sum(axis=0)[..., None] % 2 * 255 * np.ones(3)
    ramp = np.repeat(np.linspace(0, 255, 100)[None, :, None], 100, axis=0) * np.ones(3)
    assert kernels.blur_score(flat) < 1 < 1000 < kernels.blur_score(board.astype(np.uint8))
    assert 0 <= kernels.blur_score(ramp.astype(np.uint8)) <= 5000
    s = kernels.pixel_stats(flat)
    assert s["mean_r"] == s["mean_brightness"] == 128 and s["std_g"] == 0 and (s["min_val"], s["max_val"]) == (128, 128)
    marked = np.full((200, 200, 3), 180, np.uint8)
    for y in (slice(0, 20), slice(180, 200)):
        for x in (slice(0, 20), slice(180, 200)):
            marked[y, x] = 20
    c = kernels.corner_stats(marked)
    assert c["corner_mean"] == 20 and c["center_mean"] == 180 and c["delta"] == 160
    assert kernels.bounded(np.zeros((3000, 4000, 3), np.uint8), 1024).shape == (768, 1024, 3)
    rng = np.random.default_rng(0)
    a = kernels.resize(rng.integers(0, 255, (16, 16, 3), dtype=np.uint8), 128, 128)
    assert len(kernels.phash(a)) == len(kernels.dhash(a)) == 64 and kernels.phash(a, 8) == kernels.phash(kernels.resize(a, 256, 256), 8)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(42)
    d = tmp_path / "images"
    d.mkdir()
    for i in range(3):
        (d / f"normal_{i}.png").write_bytes(png(rng.integers(60, 200, (40 + 3 * i, 50 + 5 * i, 3), dtype=np.uint8)))
    (d / "dark.png").write_bytes(png(np.full((30, 30, 3), 15, np.uint8)))
    (d / "bright.png").write_bytes(png(np.full((30, 30, 3), 240, np.uint8)))
    same = png(rng.integers(60, 200, (32, 32, 3), dtype=np.uint8))
    (d / "same_a.png").write_bytes(same)
    (d / "same_b.PNG").write_bytes(same)
    (d / "corrupt.jpg").write_bytes(b"not a real image file content")
    (d / "empty.jpg").write_bytes(b"")
    (d / "notes.txt").write_text("no image")
    return d


def test_scan_resume_and_checks(spark, folder, tmp_path):
    out, e = str(tmp_path / "m"), Engine(spark)
    assert e.scan(str(folder), out) == (9, 2)
    rows = {r["filename"]: r for r in e.read(out).collect()}
    assert rows["dark.png"]["is_dark"] and rows["bright.png"]["is_overexposed"] and rows["dark.png"]["pixel_stats"]["mean_r"] == 15
    assert rows["same_a.png"]["phash"] == rows["same_b.PNG"]["phash"] and len(rows["same_a.png"]["phash"]) == 64
    assert (rows["normal_1.png"]["width"], rows["normal_1.png"]["height"], rows["normal_1.png"]["format"]) == (55, 43, "PNG")
    assert rows["empty.jpg"]["is_corrupt"] and rows["corrupt.jpg"]["is_corrupt"]
    assert e.scan(str(folder), out) == (9, 0)  # nothing is pending
    (folder / "new.png").write_bytes(png(np.full((10, 10, 3), 99, np.uint8)))
    assert e.scan(str(folder), out) == (10, 0) and e.read(out).count() == 10
    assert e.check(out, "corrupt").count() == 2 and e.check(out, "all").first()["exact_groups"] >= 1
    assert e.check(out, "duplicates").filter("kind = 'exact'").count() >= 2
    good, found = e.gate(out, Policy(min_images_total=5))
    assert not good and found.filter("name = 'max_corrupt_pct'").first()["observed"] == 20.0
    assert e.info(out)["format_counts"]["PNG"] == 8
    assert e.export(out, "csv", str(tmp_path / "c")) == 10


def test_scan_options(spark, folder, tmp_path):
    rows = images.scan(spark, str(folder), ScanConfig(extensions=(".png",), skip_pixel_stats=True, skip_blur=True, include_hashes=False, skip_exif=True)).collect()
    assert len(rows) == 7 and all(r["pixel_stats"] is None and r["phash"] is None and r["width"] > 0 for r in rows)
    assert images.run_scan(spark, str(tmp_path), str(tmp_path / "none"), ScanConfig(extensions=(".xyz",))) == (0, 0)
    assert not (tmp_path / "none").exists()


def test_report_plots_and_jobs(spark, folder, tmp_path):
    out, e = str(tmp_path / "m"), Engine(spark)
    e.scan(str(folder), out)
    page = e.report(out, str(tmp_path / "r.html"))
    text = open(page).read()
    assert text.count("<svg") == 11 and "corrupt.jpg" in text
    assert len(e.plot(out, "all", PlotConfig(output_dir=str(tmp_path / "plots")))) == 11
    assert handle(e, {"action": "aggregate", "manifest": out})["summary"]["total_images"] == 9
    assert handle(e, {"action": "list_images", "root": str(folder), "batch_size": 3})["batches"] == 3
    assert handle(e, {"action": "nothing"})["status"] == 400
    with pytest.raises(ValueError, match="svg"):
        e.plot(out, "blur", PlotConfig(output_dir=str(tmp_path / "plots"), format="pdf"))


def test_jobs_in_a_chain(spark, folder, tmp_path):
    e, out = Engine(spark), f"file://{tmp_path}/jobs"
    keys = [str(folder / n) for n in ("dark.png", "corrupt.jpg", "missing.png")]
    got = handle(e, {"action": "analyze_batch", "keys": keys, "output": f"{out}/one", "config": {"include_hashes": False}})
    assert (got["processed"], got["errors"]) == (1, 2)
    rows = {r["path"]: r for r in e.read(f"{out}/one").collect()}
    assert set(rows) == set(keys) and rows[keys[0]]["is_dark"] and rows[keys[0]]["phash"] is None and rows[keys[2]]["is_corrupt"]
    found = run_jobs(e, str(folder), str(tmp_path / "all"), batch_size=3)
    assert found["status"] == 200 and found["list_images"]["batches"] == 3 and found["aggregate"]["summary"]["total_images"] == 8  # no empty file
    assert found["merge_manifests"]["records"] == 8 and len(found["generate_plots"]["plots"]) == 11
    again = run_jobs(e, str(folder), str(tmp_path / "all"), batch_size=3)
    assert again["status"] == 200 and "analyze_batch" not in again
    assert run_jobs(e, str(tmp_path / "nowhere"), str(tmp_path / "x"))["failed"] == "list_images"


def test_scan_reads_pending_files_alone_and_shuffles_no_bytes(spark, folder, tmp_path):
    found = images.pending_files(spark, str(folder), ScanConfig())
    df = images.analysed_files(spark, spark.createDataFrame(found[:2], images.LISTING), [r[0] for r in found[:2]], ScanConfig())
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line and "image#" not in line
    assert df.count() == 2
    out, e = str(tmp_path / "m"), Engine(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        # turns of one file for each core, each appended on its own
        assert e.scan(str(folder), out, ScanConfig(checkpoint_every=1)) == (9, 2)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    turns = list((tmp_path / "m" / "records").glob("append=*"))
    assert len(turns) == 1 + -(-9 // spark.sparkContext.defaultParallelism)
    # a run that broke off after the first turn goes on with the others
    for t in sorted(turns)[2:]:
        shutil.rmtree(t)
    held = e.read(out).count()
    assert 0 < held < 9 and e.scan(str(folder), out)[0] == 9 and e.read(out).select("path").distinct().count() == 9


def test_names_with_pattern_characters(spark, tmp_path):
    d = tmp_path / "odd"
    d.mkdir()
    for n in ("a[1].png", "b{x}.png", "c*.png", "d e?.png", "f%20+.png"):
        (d / n).write_bytes(png(np.full((8, 8, 3), 120, np.uint8)))
    assert images.run_scan(spark, str(d), str(tmp_path / "o")) == (5, 0)


def test_time_limit_of_an_image():
    with pytest.raises(TimeoutError):
        with images.limited(0.05):
            time.sleep(1)
    with images.limited(0.2):
        pass
    time.sleep(0.3)  # the limit is over


def black(contents=None):
    return lambda cs: np.array([[float(len(c or b"")), 1.0, 2.0] for c in cs])


def test_embed_command(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "m")
    Engine(spark).scan(str(folder), out)
    where = ["-m", out, "-r", str(folder), "-o", str(tmp_path / "v"), "--plot-dir", str(tmp_path / "plots")]
    assert cli.main(["embed", *where]) == 1 and "open_clip" in capsys.readouterr().err
    assert cli.main(["embed", *where, "--encoder", "tests.test_images:black"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["images"] == 7 and "<circle" in open(found["plot"]).read()


def test_json_outputs(spark, folder, tmp_path):
    out = str(tmp_path / "m")
    assert cli.main(["scan", str(folder), "-o", out, "--checkpoint-every", "2"]) == 0
    assert cli.main(["gate", "-m", out, "-o", str(tmp_path / "g.json")]) == 2
    assert json.load(open(tmp_path / "g.json"))["passed"] is False
    assert cli.main(["diff", "--old", out, "--new", out, "-o", str(tmp_path / "d")]) == 0
    assert spark.read.json(str(tmp_path / "d" / "summary")).first()["unchanged_count"] == 9


def test_incremental(spark, folder, tmp_path):
    out, ck = str(tmp_path / "stream"), str(tmp_path / "ck")
    incremental.follow(spark, str(folder), out, ck).awaitTermination()
    n = spark.read.parquet(out).count()
    assert n == 8  # the source lists no empty files
    (folder / "later.png").write_bytes(png(np.full((12, 10, 3), 99, np.uint8)))
    incremental.follow(spark, str(folder), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == n + 1 and got.filter("filename = 'later.png'").first()["height"] == 12
