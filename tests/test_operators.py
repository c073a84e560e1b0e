import hashlib
import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.config import Policy, ScanConfig, extensions_of
from framelake.functions import columns as fn
from framelake.operators import checks, diff, duplicates, embeddings, gate, graph, leakage, plots, statistics, summary
from framelake.sources import manifest as files

from .rows import manifest


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact_duplicates(spark):
    m = manifest(spark, [{"phash": "abcd1234"}, {"phash": "abcd1234"}, {"phash": "different"}, {"phash": None}, {"phash": ""}])
    assert values(duplicates.exact_groups(m), "phash", "count", "first_path") == [("abcd1234", 2, "/data/0.jpg")]
    assert values(duplicates.members(m), "path", "is_first") == [("/data/0.jpg", True), ("/data/1.jpg", False)]
    m = manifest(spark, [{"phash": "abcd1234"}, {"phash": "abcd1234", "is_corrupt": True}])
    assert duplicates.exact_groups(m).count() == 0


def test_near_duplicates(spark):
    m = manifest(spark, [{"phash": "0" * 16}, {"phash": "0" * 15 + "1"}, {"phash": "f" * 16}])
    assert values(duplicates.near_clusters(m), "row_idx", "cluster") == [(0, 0), (1, 0)]


def test_bucket_cap_and_exact_recall(spark):
    rows = [{"phash": f"0000{i:012x}"} for i in (0, 1)] + [{"phash": f"0000{(i * 2654435761) % 16**12:012x}"} for i in range(2, 9)]
    m = manifest(spark, rows)
    capped = duplicates.near_pairs(m, cap=3)
    assert values(capped, "a", "b") == [(0, 1)]  # by other bands
    # bits spread over all quarters: no equal quarter
    m = manifest(spark, [{"phash": "0" * 16}, {"phash": "0001000100010001"}, {"phash": "0001000100010001"}])
    assert values(duplicates.near_pairs(m), "a", "b") == [(1, 2)]
    found = values(duplicates.near_pairs(m, exact_recall=True), "a", "b", "distance")
    assert found == [(0, 1, 4), (1, 2, 0)]


@pytest.mark.parametrize("a,b,want", [("abcd", "abcd", 0), ("a", "b", 1), ("0", "f", 4), ("xyz", "abc", 999), ("0" * 16, "0" * 15 + "1", 1), ("f" * 16, "0" * 16, 64), ("1", "01", 0)])
def test_hamming(spark, a, b, want):
    assert spark.range(1).select(fn.hamming(F.lit(a), F.lit(b))).first()[0] == want


def test_hamming_of_long_hashes(spark):
    assert spark.range(1).select(fn.hamming(F.lit("f" * 64), F.lit("0" * 64))).first()[0] == 256
    # lengths that differ, and hashes beyond 64 digits
    for a, b in (("f" * 64, "f"), ("1" + "0" * 99, "3"), ("ab" * 70, "ba" * 70), ("f", "0" * 40)):
        assert spark.range(1).select(fn.hamming(F.lit(a), F.lit(b))).first()[0] == (int(a, 16) ^ int(b, 16)).bit_count()


def leaks(spark, splits, **more):
    rows = [r | {"split": s} for s, rs in splits.items() for r in rs]
    m = manifest(spark, [{k: v for k, v in r.items() if k != "split"} for r in rows])
    tags = spark.createDataFrame([(i, r["split"]) for i, r in enumerate(rows)], "row_idx long, split string")
    return leakage.report(m.join(tags, "row_idx"), list(splits), **more)


def test_leakage(spark):
    found = leaks(spark, {"train": [{"path": "t/a", "phash": "aaaa"}, {"path": "t/b", "phash": "bbbb"}], "val": [{"path": "v/a", "phash": "aaaa"}]})
    assert values(found, "path", "found_in", "match_type") == [("t/a", "train,val", "exact"), ("v/a", "train,val", "exact")]
    found = leaks(spark, {"train": [{"path": "t/a", "phash": "aaaa0000"}], "val": [{"path": "v/a", "phash": "aaaa0001"}]})
    assert values(found, "path", "match_type", "matched_path") == [("t/a", "near", "v/a")]
    assert leaks(spark, {"a": [{"path": "x", "phash": None}], "b": [{"path": "y", "phash": None}]}).count() == 0
    assert leaks(spark, {"a": [{"path": "x", "phash": "deadbeef"}], "b": [{"path": "y", "phash": "deadbeef"}], "c": [{"path": "z", "phash": "deadbeef"}]}).count() == 3
    with pytest.raises(ValueError):
        leakage.with_splits({"one": manifest(spark, [{}])})


def test_leakage_matches_one_to_one(spark):
    found = leaks(spark, {"a": [{"path": f"a{i}", "phash": "aaaa0000"} for i in range(3)], "b": [{"path": f"b{i}", "phash": f"aaaa000{i + 1}"} for i in range(2)]})
    near = [(r["path"], r["matched_path"]) for r in found.collect()]
    assert [p for p, _ in near] == ["a0", "a1"] and len({q for _, q in near}) == 2


def test_diff(spark):
    old = manifest(spark, [{"path": "a", "width": 100}, {"path": "b", "width": 200}, {"path": "c", "width": 300}])
    new = manifest(spark, [{"path": "a", "width": 100}, {"path": "b", "width": 250}, {"path": "d", "width": 400}])
    assert values(diff.status(old, new), "path", "status") == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")]
    assert values(diff.changes(old, new), "path", "field", "old", "new") == [("b", "width", "200", "250")]
    s = diff.summary(old, new).first()
    assert (s["added_count"], s["removed_count"], s["changed_count"], s["unchanged_count"], s["total_old"]) == (1, 1, 1, 1, 3)


def test_diff_last_row_wins_and_null_is_a_change(spark):
    old = manifest(spark, [{"path": "a", "phash": "x"}, {"path": "a", "phash": None}])
    new = manifest(spark, [{"path": "a", "phash": "x"}])
    assert values(diff.changes(old, new), "field", "old", "new") == [("phash", None, "x")]
    assert [r["phash"] for r in diff.latest_only(old).collect()] == [None]


def test_pending(spark):
    have = manifest(spark, [{"path": "a", "file_size_bytes": 1, "mtime": 1.0}, {"path": "b", "file_size_bytes": 1, "mtime": 1.0}])
    listed = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 1.0)], "path string, file_size_bytes long, mtime double")
    assert values(diff.pending(listed, have), "path") == [("b",), ("c",)]


def outcome(spark, rows, **policy):
    return {r["name"]: (r["observed"], r["passed"]) for r in gate.report(manifest(spark, rows), Policy(**policy)).collect()}


def test_gate(spark):
    assert gate.passed(manifest(spark, [{"phash": str(i)} for i in range(200)]))
    assert outcome(spark, [{}])["min_images_total"] == (1.0, False)
    assert outcome(spark, [{}, {"is_corrupt": True}])["max_corrupt_pct"] == (50.0, False)
    got = outcome(spark, [{"is_dark": i == 0, "is_overexposed": i == 1} for i in range(10)])
    assert got["max_underexposed_pct"] == (10.0, False) and got["max_overexposed_pct"] == (10.0, False)
    assert outcome(spark, [{"phash": "aabb"}, {"phash": "aabb"}])["max_duplicate_pct"] == (50.0, False)
    assert outcome(spark, []) == {"min_images_total": (0.0, False)}
    assert outcome(spark, [], min_images_total=0) == {"min_images_total": (0.0, False)}


def test_gate_optional_checks(spark):
    rows = [{"is_blurry": i < 3, "has_border_artifact": i < 2} for i in range(10)]
    got = outcome(spark, rows, max_blurry_pct=20, max_artifact_pct=20, min_width=641, min_height=100, allowed_formats=("png",), max_aspect_ratio=1.0)
    assert got["max_blurry_pct"] == (30.0, False) and got["max_artifact_pct"] == (20.0, True)
    assert got["min_width"] == (640.0, False) and got["min_height"] == (480.0, True)
    assert got["allowed_formats"] == (10.0, False) and got["max_aspect_ratio"] == (1.33, False)
    assert set(outcome(spark, rows)) == {"min_images_total", "max_corrupt_pct", "max_overexposed_pct", "max_underexposed_pct", "max_duplicate_pct"}


def test_policy(tmp_path):
    p = tmp_path / "p.yml"
    p.write_text("max_corrupt_pct: 2.5\nmin_images_total: 50\nmax_duplicate_pct: 15.0\nunknown: 1\n")
    assert Policy.load(str(p)) == Policy(max_corrupt_pct=2.5, min_images_total=50, max_duplicate_pct=15.0)
    p.write_text("")
    assert Policy.load(str(p)) == Policy()
    assert extensions_of("jpg, .png") == (".jpg", ".png")
    assert ScanConfig.of({"hash_size": 8, "other": 1}).hash_size == 8


def test_summary_of_nothing(spark):
    assert set(summary.summary(manifest(spark, [])).first()) == {0}


def test_counts_and_checks(spark):
    m = manifest(spark, [{"filename": "a.JPG", "is_dark": True, "is_overexposed": True}, {"filename": "b.", "is_corrupt": True}, {"filename": "c"}, {"filename": "d.jpg", "camera_make": "Canon", "camera_model": "Canon EOS"}])
    assert values(summary.category_counts(m, "extension"), "key", "count") == [("jpg", 2)]
    assert values(checks.exposure(m), "issues") == [("dark,overexposed",)]
    assert values(checks.flagged(m), "issues") == [("corrupt",), ("dark, overexposed",)]
    assert values(plots.exif_camera(m), "camera") == [("Canon EOS",)]
    assert checks.everything(m).first()["corrupt"] == 1


def test_flag_thresholds_are_strict(spark):
    stats = (0.0,) * 6
    m = manifest(spark, [{"pixel_stats": (*stats, b, 0, 255), "corner_stats": (0.0, 0.0, 0.0, d), "blur_score": s} for b, d, s in ((40.0, 50.0, 100.0), (39.9, 50.1, 99.9), (220.1, 0.0, 500.0))])
    got = [(r["is_dark"], r["is_overexposed"], r["has_border_artifact"], r["is_blurry"]) for r in checks.flags(m).orderBy("row_idx").collect()]
    assert got == [(False, False, False, False), (True, False, True, True), (False, True, False, False)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=12))
def test_components_equal_union_find(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(values(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "label"))
    assert got == {x: find(x) for x in parent}


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert values(graph.components(links).groupBy("label").count(), "label", "count") == [(0, 61)]


def test_order_statistics(spark):
    import numpy as np

    x = np.random.default_rng(1).lognormal(size=30_000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert np.allclose(statistics.percentiles(df, "v", [0.05, 0.5, 0.99]), np.percentile(x, [5, 50, 99]))
    assert statistics.percentiles(df.filter("v < 0"), "v", [0.5]) == [None]
    assert statistics.percentiles(spark.createDataFrame([(3.0,)] * 20_000, "v double"), "v", [0.5]) == [3.0]


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 16)) + 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] *= -1
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert 0 in [r["vec_id"] for r in embeddings.outliers(v).collect()]
    y = np.eye(10)
    y[2] = y[0]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(y)], "vec_id long, embedding array<float>")
    assert values(embeddings.semantic_pairs(v, 0.99), "a", "b") == [(0, 2)]
    assert embeddings.project(v).count() == 10


def test_semantic_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(13)], "vec_id long, embedding array<double>")
    want = sorted((i, j) for i in range(13) for j in range(i + 1, 13) if 1 + (i % 3) * (j % 3) >= 2)
    assert values(embeddings.semantic_pairs(v, 2.0), "a", "b") == want


def test_compute_embeddings(spark):
    import numpy as np

    images = spark.createDataFrame([("a", b"12"), ("b", None)], "path string, content binary")
    got = {r["path"]: r["embedding"] for r in embeddings.compute(images, lambda: lambda cs: np.array([[3.0, 4.0] if c else [0.0, 2.0] for c in cs])).collect()}
    assert np.allclose(got["a"], [0.6, 0.8]) and np.allclose(got["b"], [0, 1])


def test_manifest_files(spark, tmp_path):
    m = manifest(spark, [{"pixel_stats": (1.0,) * 7 + (0, 255), "camera_make": "Canon"}, {"is_corrupt": True}])
    path = str(tmp_path / "m")
    files.write_jsonl(m, path, {"input_dir": "/x", "settings": {"a": "1"}})
    meta, rows = files.read_jsonl(spark, path)
    assert meta.first()["input_dir"] == "/x" and rows.count() == 2
    files.append_jsonl(m, path)
    files.write_meta(spark, path, {"input_dir": "/y"})
    meta, rows = files.read_jsonl(spark, path)
    assert [r["input_dir"] for r in meta.collect()] == ["/y"] and rows.count() == 4


@pytest.mark.parametrize("sizes", [(3, 400, 20), (400, 3, 1), (1, 1, 1)])
def test_rows_keep_the_order_of_appends(spark, tmp_path, sizes):
    """Later appends win, whichever is the largest; rows of a file keep their order."""
    path = str(tmp_path / "m")
    for k, n in enumerate(sizes):
        rows = manifest(spark, [{"path": f"p{i}", "width": k, "height": i + 1} for i in range(n)]).repartition(3, "height").sortWithinPartitions("height")
        files.append_jsonl(rows, path) if k else files.write_jsonl(rows, path, {})
    _, got = files.read_jsonl(spark, path)
    held = [(r["width"], r["path"]) for r in got.orderBy("row_idx").collect()]
    assert [w for w, _ in held] == sorted(w for w, _ in held) and len(held) == sum(sizes) and got.select("row_idx").distinct().count() == len(held)
    last = {r["path"]: r["width"] for r in diff.latest_only(got).collect()}
    assert last == {f"p{i}": max(k for k, n in enumerate(sizes) if i < n) for i in range(max(sizes))}


def test_long_files_in_blocks(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text("".join(f'{{"path": "p{i}", "width": {i}}}\n' + "\n" * (i % 3) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.read_jsonl(spark, str(p))[1].orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["width"] for r in rows] == list(range(3000)) and len({r["row_idx"] for r in rows}) == 3000


def test_odd_values_are_kept(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    lines = ['{"path": "a", "width": 640.0, "height": "480", "blur_score": 3, "pixel_stats": {"mean_r": 1, "max_val": 9.0}, "is_dark": "yes", "camera_make": 7}', '{"path": "b", "width": "wide", "pixel_stats": 3, "corner_stats": [1]}', '{"path": "c", "width": null, "is_corrupt": true}', '{"path": "d"} x', '{"path": "e", "wid']
    p.write_text("\n".join(lines))
    rows = {r["path"]: r for r in files.read_jsonl(spark, str(p))[1].collect()}
    assert (rows["a"]["width"], rows["a"]["height"], rows["a"]["blur_score"], rows["a"]["camera_make"]) == (640, 480, 3.0, "7")
    assert rows["a"]["pixel_stats"]["mean_r"] == 1.0 and rows["a"]["pixel_stats"]["max_val"] == 9 and rows["a"]["is_dark"]
    assert rows["b"]["width"] == 0 and rows["b"]["pixel_stats"] is None and rows["c"]["is_corrupt"]
    assert set(rows) | {"d"} == {"a", "b", "c", "d"} and len(rows) + files.damaged(spark, str(p)) == len(lines)
    for other in ("[1, 2]", "5", '"text"', "null"):
        p.write_text('{"path": "a"}\n' + other + "\n")
        with pytest.raises(Exception, match="no object"):
            files.read_jsonl(spark, str(p))[1].collect()


def test_torn_lines_and_headers(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"__manifest_meta__": true, "input_dir": "/d"}\n\n{"path": "/data/a.jpg", "extra": 1}\n{"__manifest_meta__": true}\n{"path": "/data/b.jpg", "trunc')
    _, rows = files.read_jsonl(spark, str(p))
    assert [(r["path"], r["format"], r["width"]) for r in rows.collect()] == [("/data/a.jpg", "", 0)]
    assert files.read_jsonl(spark, str(tmp_path / "none"))[1].count() == 0
    got = files.merge_files(spark, [str(p), str(tmp_path / "none")], str(tmp_path / "out"), {})
    assert got == {"records": 1, "skipped_lines": 1, "missing_parts": 1}


def test_exports(spark, tmp_path):
    m = manifest(spark, [{"phash": f"{i:016x}", "camera_make": "Canon" if i % 2 == 0 else None, "focal_length_35mm": 14 if i == 0 else None} for i in range(20)])
    assert files.to_csv(m, str(tmp_path / "c")) == 20
    got = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert len(got.columns) == 41 and got.count() == 20
    assert files.to_csv(m.limit(0), str(tmp_path / "e")) == 0 and not (tmp_path / "e").exists()
    files.to_parquet(m, str(tmp_path / "p"))
    r = spark.read.parquet(str(tmp_path / "p")).filter("path = '/data/1.jpg'").first()
    assert r["camera_make"] == "" and r["focal_length_35mm"] == 0 and r["pixel_stats.mean_r"] == 0.0 and r["pixel_stats.max_val"] == 255


def test_batches(spark):
    keys = spark.range(45).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("path"))
    assert values(files.batches(keys, 20).groupBy("batch").count(), "batch", "count") == [(0, 20), (1, 20), (2, 5)]


def test_fixed_places_as_printed(spark):
    xs = [1.005, 1.015, 2.675, 0.125, 0.375, 1.225, 123456.785, 0.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(fn.fixed2(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.2f}" for x in xs]


def test_bands_with_constant_digits(spark):
    """Digits that never vary don't fill a bucket with all rows; each bit is in one band."""
    for words, bands in ((1, 4), (1, 9), (4, 9), (3, 7)):
        masks = duplicates.spread_masks(words, bands)
        assert all(sum(m[w] & (1 << 64) - 1 for m in masks) == (1 << 64) - 1 for w in range(words))
        assert all(a[w] & b[w] == 0 for w in range(words) for a, b in itertools.combinations(masks, 2))
    # digits 6 to 15 are the same in all: the old bands 1 and 2 (bits 28 to 84) were nearly constant
    draw = random.Random(5)
    hashes = ["".join("0" if 6 <= k < 24 else draw.choice("0123456789abcdef") for k in range(64)) for _ in range(400)]
    hashes += [hashes[0][:-2] + "%02x" % (int(hashes[0][-2:], 16) ^ 255)]
    nodes = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "row_idx long, phash string").select("row_idx", fn.words64(F.col("phash"), 4).alias("w"))
    keyed = duplicates.with_keys(nodes, 4, 9)
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] <= 10
    m = manifest(spark, [{"phash": h} for h in hashes])
    assert values(duplicates.near_pairs(m, exact_recall=True), "a", "b", "distance") == [(0, 400, 8)]


def test_clusters_find_links_once(spark, monkeypatch):
    """The links are written before they are turned around, so the join isn't run for each direction."""
    written = []
    monkeypatch.setattr(duplicates, "cut", lambda df: written.append(df.columns) or graph.cut(df))
    m = manifest(spark, [{"phash": f"{h:064x}"} for h in (0, 1, 3, 3, 3 << 200)])
    found = duplicates.near_clusters(m, threshold=1, exact_recall=True)
    assert values(found, "row_idx", "cluster") == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert ["a", "b"] in written


def test_leakage_rounds(spark, monkeypatch):
    """Sixty rows want thirty partners: a row doesn't ask, one a round, for each partner that an earlier row holds."""
    written = []
    monkeypatch.setattr(leakage, "cut", lambda df: written.append(df.columns) or graph.cut(df))
    a, b = [f"a{i:02}" for i in range(60)], [f"b{i:02}" for i in range(30)]
    found = leaks(spark, {"a": [{"path": p, "phash": "aaaa0000"} for p in a], "b": [{"path": p, "phash": "aaaa0001"} for p in b]})
    left, want = set(b), {}
    for p in a[:30]:
        want[p] = min(left, key=lambda q: hashlib.md5(f"{p}|{q}".encode()).hexdigest())
        left.remove(want[p])
    assert {r["path"]: r["matched_path"] for r in found.collect()} == want
    assert len(written) <= 24
