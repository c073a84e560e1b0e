"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..schema import CSV_COLUMNS, PARQUET_BASE, PARQUET_NESTED
from .fixtures import BOXES_SQL, MANIFEST_SQL, OLD_NEW_SQL, SPLIT_SQL
from .queries import BATCH, PROBE, SAMPLE, SIMILARITY

FIELDS = ("file_size_bytes", "width", "height", "format", "color_mode", "is_corrupt", "is_dark", "is_overexposed", "has_border_artifact", "phash")


#: Columns that the manifest view leaves absent, its statistics, and what both are in flat exports.
ABSENT = "null::varchar as lens_model, null::double as focal_length_mm, null::double as f_number, null::double as exposure_time_sec, null::varchar as datetime_original, null::varchar as dhash"
STATS = "mean_r, mean_g, mean_b, 0.0::double as std_r, 0.0::double as std_g, 0.0::double as std_b, mean_brightness, 0 as min_val, 255 as max_val, 0.0::double as corner_mean, 0.0::double as center_mean, 0.0::double as border_mean, delta"
BOOLEANS = {"has_gps_data", "is_blurry", "is_corrupt", "is_dark", "is_overexposed", "has_border_artifact"}
ZERO, NUMBERS = "0.0::double", {"focal_length_mm", "f_number", "exposure_time_sec"}
CELLS = {n: "''" for n in ("lens_model", "datetime_original", "dhash", "analyzed_at", *NUMBERS)} | {n: ZERO for n in ("std_r", "std_g", "std_b", "corner_mean", "center_mean", "border_mean")} | {"corner_delta": "delta"}
TEXTS = {"path", "filename", "format", "color_mode", "camera_make", "camera_model", "lens_model", "datetime_original", "distortion_risk", "phash", "dhash", "analyzed_at"}


def cell(name: str) -> str:
    """A column of the flat Parquet form over the view."""
    last = name.rpartition(".")[2]
    return {"min_val": "0", "max_val": "255"}.get(last) or (ZERO if last in NUMBERS else CELLS.get(last, last))


def empty(name: str) -> str:
    return "''" if name in TEXTS else "0"


def m(sql: str, more: str = "", prelude: str = MANIFEST_SQL) -> str:
    """``sql`` over the manifest views and further ones."""
    return f"with recursive {prelude}{', ' + more if more else ''} {sql}"


def b(sql: str, more: str = "") -> str:
    return m(sql, more, BOXES_SQL)


def dn(sql: str, more: str = "") -> str:
    return m(sql, more, OLD_NEW_SQL)


def distance(a: str, c: str) -> str:
    halves = " + ".join(f"bit_count(xor(('0x' || substr({a}, {i}, 8))::bigint, ('0x' || substr({c}, {i}, 8))::bigint))::int" for i in range(1, 65, 8))
    return f"({halves})::int"


def counts(column: str) -> str:
    return m(f'select {column} as key, count(*) as "count", row_number() over (order by count(*) desc, min(row_idx)) as rank from manifest where {column} <> \'\' group by {column}')


EXTENSION = "case when contains(filename, '.') and split_part(filename, '.', -1) <> '' then lower(split_part(filename, '.', -1)) end"
EXIF = "count(*) filter (where camera_make <> '') as exif_count, count(*) filter (where distortion_risk = 'high') as high_distortion_count, count(*) filter (where has_gps_data) as gps_count, count(*) filter (where orientation_tag <> 1) as rotated_count"
GROUPS = 'groups as (select phash, count(*) as "count", min_by(path, row_idx) as first_path, min(row_idx) as first_idx from hashable group by phash having count(*) > 1)'
DUPS = f"""banded as (select row_idx, path, phash, i, substr(phash, 1 + i * 16, 16) as sub from hashable, range(4) r(i)),
  buckets as (select i, sub from banded group by i, sub having count(*) between 2 and 500),
  pairs as (select distinct x.row_idx as a, y.row_idx as b, {distance("x.phash", "y.phash")} as distance from banded x join banded y on x.i = y.i and x.sub = y.sub and x.row_idx < y.row_idx
    join buckets k on k.i = x.i and k.sub = x.sub where {distance("x.phash", "y.phash")} <= 8)"""
CLUSTERS = """edges as (select a, b from pairs union select b, a from pairs), reach(n, l) as (select a, a from edges union select e.b, r.l from reach r join edges e on r.n = e.a),
  clusters as (select n as row_idx, min(l) as cluster from reach group by n)"""
FLAGS = {"corrupt": "is_corrupt", "dark": "is_dark", "overexposed": "is_overexposed", "blurry": "is_blurry", "artifact": "has_border_artifact"}
ISSUES = "concat_ws(', ', " + ", ".join(f"case when {c} then '{n}' end" for n, c in FLAGS.items()) + ")"
LEAKS = "shared as (select phash, string_agg(distinct split, ',' order by split) as found_in from s where phash <> '' group by phash having count(distinct split) > 1)"
NEAR_LEAKS = " union all ".join(
    f"""select distinct '{x}' as split_a, '{y}' as split_b, p.path as path_a, q.path as path_b, {distance("p.phash", "q.phash")} as distance
    from (select * from quarters where split = '{x}') p join (select * from quarters where split = '{y}') q on p.sub = q.sub where p.phash <> q.phash and {distance("p.phash", "q.phash")} <= 8"""
    for x, y in (("train", "val"), ("train", "test"), ("val", "test"))
)
JOINED = f"""a as (select *, row_number() over (partition by path order by row_idx desc) as k from old), c as (select *, row_number() over (partition by path order by row_idx desc) as k from new),
  j as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when {" or ".join(f"o.{f} is distinct from n.{f}" for f in FIELDS)} then 'changed' else 'unchanged' end as status,
    {", ".join(f"o.{f} as o_{f}, n.{f} as n_{f}" for f in FIELDS)} from (select * from a where k = 1) o full join (select * from c where k = 1) n on o.path = n.path)"""


def bins(v: str, n: str, low: str = "lo", high: str = "hi") -> str:
    return f"least(floor(({v} - {low}) / ({high} - {low}) * {n}), {n} - 1)::int"


def histogram(source: str, v: str, n: str, extra: str = "", where: str = "true") -> str:
    return m(f'select {bins("v", "n")} as bin, count(*) as "count"{extra} from h group by 1', f"""g as (select ({v})::double as v, * from {source} where {where}), e as (select min(v) as l0, max(v) as h0, {n} as n from g),
      h as (select g.*, case when l0 = h0 then l0 - 0.5 else l0 end as lo, case when l0 = h0 then h0 + 0.5 else h0 end as hi, e.n from g, e)""")


GATE = """t as (select count(*) as n, count(*) filter (where is_corrupt) as corrupt, count(*) filter (where is_overexposed) as bright, count(*) filter (where is_dark) as dark,
    count(*) filter (where is_blurry) as blurry, count(*) filter (where has_border_artifact) as artifact, coalesce(min(width) filter (where not is_corrupt), 0) as width,
    coalesce(min(height) filter (where not is_corrupt), 0) as height, count(*) filter (where not is_corrupt and upper(format) not in ('JPEG', 'PNG')) as bad,
    coalesce(max(aspect_ratio) filter (where not is_corrupt), 0) as ratio, (select coalesce(sum("count" - 1), 0) from groups) as dups from manifest)"""


def share(order: int, name: str, limit: float, n: str) -> str:
    return f"select {order} as ord, '{name}' as name, {limit}::double as threshold, round({n} * 100.0::double / n, 2) as observed, {n} * 100.0::double / n <= {limit} as passed from t"


ORACLE: dict[str, str] = {
    "aggregate_summary": m(f"""select count(*) as total_images, coalesce(sum(file_size_bytes), 0)::bigint as total_size_bytes, count(*) filter (where is_corrupt) as corrupt_count, count(*) filter (where is_dark) as dark_count,
      count(*) filter (where is_overexposed) as overexposed_count, count(*) filter (where has_border_artifact) as artifact_count, count(*) filter (where is_blurry) as blurry_count,
      {", ".join(f"coalesce({f}({c}) filter (where not is_corrupt), 0)::int as {f}_{c}" for c in ("width", "height") for f in ("min", "max"))}, {EXIF} from manifest"""),
    "format_counts": counts("format"),
    "mode_counts": counts("color_mode"),
    "extension_counts": m(f'select key, count(*) as "count", row_number() over (order by count(*) desc, min(row_idx)) as rank from (select {EXTENSION} as key, row_idx from manifest) where key <> \'\' group by key'),
    "camera_make_counts": counts("camera_make"),
    "camera_model_counts": counts("camera_model"),
    "category_counts_grouping_sets": m('select dimension, key, count(*) as "count", row_number() over (partition by dimension order by count(*) desc, min(row_idx)) as rank from u where key <> \'\' group by dimension, key',
      "u as (" + " union all ".join(f"select '{d}' as dimension, {c} as key, row_idx from manifest" for d, c in (("format", "format"), ("color_mode", "color_mode"), ("extension", EXTENSION), ("camera_make", "camera_make"), ("camera_model", "camera_model"))) + ")"),
    "exif_summary": m(f"select {EXIF} from manifest"),
    "check_corrupt": m("select path, filename from manifest where is_corrupt"),
    "check_exposure": m("select path, concat_ws(',', case when is_dark then 'dark' end, case when is_overexposed then 'overexposed' end) as issues, mean_brightness from manifest where is_dark or is_overexposed"),
    "check_artifacts": m("select path, delta from manifest where has_border_artifact"),
    "check_blur": m("select path, blur_score from manifest where is_blurry"),
    "check_all": m("""select count(*) filter (where is_corrupt) as corrupt, count(*) filter (where is_dark) as dark, count(*) filter (where is_overexposed) as overexposed, count(*) filter (where has_border_artifact) as artifacts,
      (select coalesce(sum("count" - 1), 0)::bigint from groups) as duplicate_images, (select count(*) from groups) as exact_groups, (select count(distinct cluster) from clusters) as near_groups from manifest""", f"{GROUPS}, {DUPS}, {CLUSTERS}"),
    "report_flagged": m(f"select path, {ISSUES} as issues from manifest where {' or '.join(FLAGS.values())}"),
    "flag_thresholds": m("select path, is_dark, is_overexposed, has_border_artifact, is_blurry from manifest"),
    "distortion_risk": m("select path, distortion_risk as risk from manifest"),
    "aspect_ratio": m("select path, aspect_ratio from manifest"),
    "fmt_bytes": m("select path, case when n > 1000000000 then printf('%.2f GB', n / 1e9) when n > 1000000 then printf('%.2f MB', n / 1e6) else printf('%.2f KB', n / 1e3) end as size from (select path, file_size_bytes * (case row_idx % 3 when 0 then 1 when 1 then 1000 else 1000000 end) as n from manifest)"),
    "format_size": m("""select path, (case when v >= 100 then format('{:,.0f}', v) when v >= 10 then format('{:,.1f}', v) else format('{:,.2f}', v) end) || ' ' || u as size
      from (select path, case when kb >= 1048576 then kb / 1048576 when kb >= 1024 then kb / 1024 else kb end as v, case when kb >= 1048576 then 'GB' when kb >= 1024 then 'MB' else 'KB' end as u
        from (select path, width * (case row_idx % 3 when 0 then 0.0625 when 1 then 1.0 else 2048.0 end)::double as kb from manifest))"""),
    "exact_duplicates": m('select phash, "count", first_path from groups', GROUPS),
    "duplicate_count": m('select coalesce(sum("count" - 1), 0)::bigint as duplicates from groups', GROUPS),
    "duplicate_members": m("select phash, path, row_idx = first_idx as is_first from hashable join groups using (phash)", GROUPS),
    "plot_duplicates": m('select "count" as group_size, count(*) as groups from groups group by "count" union all select 1, (select count(*) from manifest) - (select coalesce(sum("count"), 0) from groups)::bigint', GROUPS),
    "hamming_distance": m(f"select path, {distance('phash', chr(39) + PROBE + chr(39))} as distance from manifest"),
    "near_dup_pairs": m("select a, b, distance from pairs", DUPS),
    "near_dup_pairs_exact": m(f"""select x.r as a, y.r as b, {distance("x.phash", "y.phash")} as distance from n x join n y on x.r < y.r and {distance("x.phash", "y.phash")} <= 3
      union all select r, row_idx, 0 from hashable join n using (phash) where row_idx <> r""", "n as (select phash, min(row_idx) as r from hashable group by phash)"),
    "near_dup_clusters": m("select row_idx, cluster from clusters", f"{DUPS}, {CLUSTERS}"),
    "leakage_exact": m("select path, min_by(phash, row_idx) as phash, min_by(found_in, row_idx) as found_in from s join shared using (phash) group by path", LEAKS, SPLIT_SQL),
    "leakage_near_pairs": m(NEAR_LEAKS, "quarters as (select distinct split, path, phash, row_idx, substr(phash, 1 + i * 16, 16) as sub from s, range(4) r(i) where phash <> '')", SPLIT_SQL),
    "diff_added": dn("select distinct path from new where path not in (select path from old)"),
    "diff_removed": dn("select distinct path from old where path not in (select path from new)"),
    "diff_status": dn("select path, status from j", JOINED),
    "diff_changes": dn(" union all ".join(f"select path, '{f}' as field, o_{f}::varchar as old, n_{f}::varchar as new from j where status = 'changed' and o_{f} is distinct from n_{f}" for f in FIELDS), JOINED),
    "diff_summary": dn(f"""select {", ".join(f"count(*) filter (where status = '{s}') as {s}_count" for s in ("added", "removed", "changed", "unchanged"))},
      {", ".join(f"(select count(*) from {t}) as total_{t}, (select count(*) from {t} where is_corrupt) as corrupt_{t}, (select count(*) from (select phash from {t} where not is_corrupt and phash <> '' group by phash having count(*) > 1)) as duplicate_groups_{t}" for t in ("old", "new"))} from j""", JOINED),
    "latest_only": dn("select path, max(row_idx) as row_idx, max(height) as height from (select path, row_idx, height from old union all select path, row_idx, height from new) group by path"),
    "resume_pending": m("select path, file_size_bytes, mtime from manifest where not (row_idx % 3 = 0 and row_idx % 6 <> 0)"),
    "merge_manifests": m("select path, file_size_bytes, width, height, (count(*) over ())::bigint as records, 1::bigint as skipped_lines, 1::bigint as missing_parts from (select path, file_size_bytes, width, height from manifest union all select 'odd/a', 7, 640, 480 union all select 'odd/b', 0, 0, 0)"),
    "manifest_roundtrip": m(f"select path, filename, file_size_bytes, mtime, width, case when row_idx % 50 = 0 then 3 else height end as height, format, color_mode, num_channels, aspect_ratio, camera_make, camera_model, focal_length_35mm, iso_speed, orientation_tag, has_gps_data, distortion_risk, phash, blur_score, is_blurry, is_corrupt, is_dark, is_overexposed, has_border_artifact, {ABSENT}, {STATS} from manifest"),
    "gate_report": m(f"""select 1 as ord, 'min_images_total' as name, 100.0::double as threshold, n::double as observed, n >= 100 as passed from t
      union all {" union all ".join(share(2 + k, name, limit, n) for k, (name, limit, n) in enumerate((("max_corrupt_pct", 1.0, "corrupt"), ("max_overexposed_pct", 5.0, "bright"), ("max_underexposed_pct", 5.0, "dark"), ("max_duplicate_pct", 10.0, "dups"), ("max_blurry_pct", 50.0, "blurry"), ("max_artifact_pct", 50.0, "artifact"))))}
      union all select 8, 'min_width', 80.0, width::double, width >= 80 from t union all select 9, 'min_height', 80.0, height::double, height >= 80 from t
      union all select 10, 'allowed_formats', 0.0, bad::double, bad = 0 from t union all select 11, 'max_aspect_ratio', 3.0, round(ratio, 2), ratio <= 3.0 from t""", f"{GROUPS}, {GATE}"),
    "gate_samples": m("select name, place, path from (select name, path, row_number() over (partition by name order by g, row_idx)::int as place from f) where place <= 10", f"""{GROUPS}, f as (
      {" union all ".join(f"select '{n}' as name, 0 as g, row_idx, path from manifest where {c}" for n, c in (("max_corrupt_pct", "is_corrupt"), ("max_overexposed_pct", "is_overexposed"), ("max_underexposed_pct", "is_dark"), ("max_blurry_pct", "is_blurry"), ("max_artifact_pct", "has_border_artifact")))}
      union all select 'max_duplicate_pct', first_idx, row_idx, path from hashable join groups using (phash) where row_idx <> first_idx)"""),
    "annotation_stats": b("""select count(*) as total_images, count(*) filter (where objects > 0) as annotated_images, count(*) filter (where objects = 0) as unannotated_images, round(avg(objects), 6) as mean_objects_per_image,
      max(objects) as max_objects_per_image, (select count(*) from boxes) as total_annotations, (select count(distinct class_name) from boxes) as num_classes from per_image"""),
    "class_counts": b('select class_name, count(*) as "count", row_number() over (order by count(*) desc, class_name) as rank, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as pct from boxes group by class_name'),
    "bbox_size_classes": b("select case when area < 0.01 then 'small' when area < 0.1 then 'medium' else 'large' end as size_class, count(*) as \"count\" from boxes group by 1"),
    "bbox_stats": b("select " + ", ".join(f"round({f}({c}), 6) as {n}_{name}" for c, name in (("w", "width"), ("h", "height"), ("area", "area"), ("case when h > 0 then w / h end", "aspect")) for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + ", count(*) filter (where h > 0) as with_height from boxes"),
    "bbox_normalize": b("""select image, count(*) as n, """ + ", ".join(f"round(sum(round({e}, 9)), 8) as {k}_{n}" for k, w, h in (("coco", "pw", "ph"), ("voc", "((px + pw) - px)", "((py + ph) - py)")) for n, e in (
      ("x", f"case when iw > 0 then (px + {w} / 2) / iw else 0 end"), ("y", f"(py + {h} / 2) / 600"), ("w", f"case when iw > 0 then {w} / iw else 0 end"), ("h", f"{h} / 600"), ("area", f"(case when iw > 0 then {w} / iw else 0 end) * ({h} / 600)"))) + " from p group by image",
      "p as (select image, round(x * 400) as px, round(y * 300) as py, round(w * 200) as pw, round(h * 150) as ph, case when image::bigint % 7 = 0 then 0 else 800 end as iw from boxes)"),
    "co_occurrence": b("select p.class_name as class_a, q.class_name as class_b, count(*) as images from (select distinct image, class_name from boxes) p join (select distinct image, class_name from boxes) q on p.image = q.image and p.class_name <> q.class_name group by 1, 2"),
    "objects_per_image": b("select objects, count(*) as images from per_image group by objects"),
    "bbox_heatmap": b("select least(floor((x - 0.0::double) / 1.0::double * 20), 19)::int as cell_x, least(floor((y - 0.0::double) / 1.0::double * 20), 19)::int as cell_y, count(*) as \"count\" from boxes where x between 0 and 1 and y between 0 and 1 group by 1, 2"),
    "orphan_annotations": b("select distinct image from boxes where image not in (select image from images where image::bigint % 10 <> 0) order by image limit 100"),
    "unannotated_images": b("select image from per_image where objects = 0"),
    "split_class_counts": b("select case when image::bigint % 5 = 0 then 'val' else 'train' end as split, class_name, count(*) as \"count\" from boxes join images using (image) group by 1, 2"),
    "embedding_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings",
    "embedding_centroid": "with c as (select i - 1 as pos, avg(v) as mean from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings) group by i) select pos::int as pos, round(mean / (select sqrt(sum(mean * mean)) from c), 6) as value from c",
    "embedding_outliers": """with c as (select i, avg(v) as mean from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings) group by i), n as (select list(mean / (select sqrt(sum(mean * mean)) from c) order by i) as c from c),
      s as (select vec_id, list_dot_product(embedding::double[], n.c) as similarity from embeddings, n) select vec_id, round(similarity, 6) as similarity from s where similarity < (select quantile_cont(similarity, 0.05) from s)""",
    "semantic_duplicates": f"select p.vec_id as a, q.vec_id as b, round(list_dot_product(p.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings p join embeddings q on p.vec_id < q.vec_id where list_dot_product(p.embedding::double[], q.embedding::double[]) >= {SIMILARITY}",
    "file_size_percentiles": m("select " + ", ".join(f"round(quantile_cont(file_size_bytes / 1024.0::double, {q}), 6) as {n}_kb" for n, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))) + " from valid"),
    "file_size_hist": m('select least(floor((log10(kb) - log10(lo)) / (log10(hi) - log10(lo)) * (n - 1)), n - 2)::int as bin, count(*) as "count" from k, e where kb >= lo group by 1',
      "k as (select file_size_bytes / 1024.0::double as kb from valid), e0 as (select greatest(min(kb), 0.1) as lo, max(kb) as hi, greatest(15, least(80, floor(1.5 * sqrt(count(*)))::int)) as base from k), e as (select lo, hi, case when hi / lo > 1000 then least(100, floor(base * 1.3)::int) else base end as n from e0)"),
    "plot_dimensions": m(f"""select case when (select count(*) from valid) <= 5000 then width else {bins("width::double", "50", "wl", "wh")} end as x, case when (select count(*) from valid) <= 5000 then height else {bins("height::double", "50", "hl", "hh")} end as y, count(*) as "count" from valid, e group by 1, 2""",
      "e as (select min(width)::double as wl, max(width)::double as wh, min(height)::double as hl, max(height)::double as hh from valid)"),
    "plot_aspect_ratio": histogram("valid", "aspect_ratio", "least(60, greatest(20, count(*) // 5))::int", where="aspect_ratio > 0"),
    "plot_brightness": m(f"""select bin, "count", case when lo + bin * ((hi - lo) / 60) < 40 then 'dark' when lo + bin * ((hi - lo) / 60) > 220 then 'overexposed' else 'normal' end as zone from (select {bins("mean_brightness", "60")} as bin, lo, hi, count(*) as "count" from valid, e group by all)""", "e as (select min(mean_brightness) as lo, max(mean_brightness) as hi from valid)"),
    "plot_channels": m(" union all ".join(f"select '{c}' as channel, min(mean_{c}) as low, round(avg(mean_{c}), 6) as mean, quantile_cont(mean_{c}, 0.5) as median, max(mean_{c}) as high from valid" for c in "rgb")),
    "plot_artifacts": histogram("valid", "delta", "60", ', count(*) filter (where v > 50) as "over"'),
    "plot_blur": histogram("valid", "blur_score", "80", ", count(*) filter (where v < 100) as blurry"),
    "plot_exif_camera": m("""select camera, count(*) as "count", row_number() over (order by count(*) desc, min(row_idx)) as rank from (select row_idx, case when camera_make <> '' and not starts_with(camera_model, camera_make) then camera_make || ' ' || camera_model else camera_model end as camera from valid where camera_model <> '') group by camera order by 2 desc limit 15"""),
    "plot_exif_focal": histogram("valid", "focal_length_35mm", "50", where="focal_length_35mm > 0"),
    "plot_exif_zones": m("select case when focal_length_35mm < 24 then 'Ultra-wide' when focal_length_35mm < 35 then 'Wide' when focal_length_35mm < 70 then 'Normal' when focal_length_35mm < 200 then 'Telephoto' else 'Super-telephoto' end as zone, count(*) as \"count\" from valid where focal_length_35mm > 0 group by 1"),
    "plot_exif_iso": histogram("valid", "iso_speed", "50", ", count(*) filter (where v >= 3200) as high_noise", "iso_speed > 0"),
    "flatten_csv": m("select " + ", ".join(f"case when {c} then 'True' else 'False' end as {c}" if c in BOOLEANS else f"coalesce({CELLS.get(c, c)}::varchar, '') as {c}" for c, _ in CSV_COLUMNS) + " from manifest"),
    "flatten_parquet": m("select " + ", ".join(f"{c} as {c}" if c in BOOLEANS else f"coalesce({cell(c)}, {empty(c)}) as {c.replace('.', '_')}" for c in (*PARQUET_BASE, *PARQUET_NESTED)) + " from manifest"),
    "sample_n": m(f"select path from valid order by md5(path || '42'), path limit {SAMPLE}"),
    "batch_chunks": m(f"select (k // {BATCH})::bigint as batch, count(*) as n, min(path) as first_path from (select path, row_number() over (order by row_idx) - 1 as k from manifest) group by 1"),
    "size_estimate": m("select sum(file_size_bytes)::bigint as exact_bytes, floor((select avg(file_size_bytes) from (select file_size_bytes from manifest order by row_idx limit 100)) * count(*))::bigint as estimated_bytes from manifest"),
    "classification_split_counts": m("select split_part(path, '/', 2) as folder, count(*) as images from manifest group by 1"),
    "pixel_stats_sql": "with p as (select l_orderkey, floor(l_quantity * 5)::double as r, floor(l_discount * 2000)::double as g, floor(l_tax * 3000)::double as b from lineitem) select l_orderkey, " + ", ".join(f"round({f}({c}), 6) as {n}_{c}" for c in "rgb" for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + ", round(avg((r + g + b) / 3), 6) as mean_brightness, min(least(r, g, b)) as min_val, max(greatest(r, g, b)) as max_val from p group by l_orderkey",
}
