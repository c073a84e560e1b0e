"""Plots as SVG and the report as HTML, from aggregated tables of bounded size."""

from __future__ import annotations

import html
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PlotConfig
from . import annotations, checks, duplicates, plots, summary

W, H, PAD = 640, 360, 44
FLAGGED, MAKES = 200, 10


def bars(title: str, labels: Sequence[str], values: Sequence[float]) -> str:
    """A bar chart."""
    top, n = max([*values, 1]), max(len(values), 1)
    step = (W - 2 * PAD) / n
    body = [f'<text x="{W / 2}" y="20" text-anchor="middle" font-size="14">{html.escape(title)}</text>']
    for i, (label, v) in enumerate(zip(labels, values, strict=True)):
        h = (H - 2 * PAD) * v / top
        body.append(f'<rect x="{PAD + i * step:.1f}" y="{H - PAD - h:.1f}" width="{max(step - 1, 0.5):.1f}" height="{h:.1f}" fill="#4878a8"><title>{html.escape(str(label))}: {v:g}</title></rect>')
        if n <= 12 or i % (n // 6) == 0:
            body.append(f'<text x="{PAD + (i + 0.5) * step:.1f}" y="{H - PAD + 14}" text-anchor="middle" font-size="9">{html.escape(str(label))[:14]}</text>')
    body.append(f'<line x1="{PAD}" y1="{H - PAD}" x2="{W - PAD}" y2="{H - PAD}" stroke="#444"/>')
    if not values:
        body.append(f'<text x="{W / 2}" y="{H / 2}" text-anchor="middle">No data</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {W} {H}" font-family="sans-serif">{"".join(body)}</svg>'


def grid(title: str, cells: Sequence[tuple[float, float, float]], n: int) -> str:
    """Counts on an n x n grid as shades."""
    top = max([*(c for _, _, c in cells), 1])
    sx, sy = (W - 2 * PAD) / n, (H - 2 * PAD) / n
    body = [f'<rect x="{PAD + x * sx:.1f}" y="{PAD + y * sy:.1f}" width="{sx:.1f}" height="{sy:.1f}" fill="#4878a8" fill-opacity="{0.1 + 0.9 * c / top:.3f}"/>' for x, y, c in cells]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {W} {H}" font-family="sans-serif"><text x="{W / 2}" y="20" text-anchor="middle" font-size="14">{html.escape(title)}</text>{"".join(body)}</svg>'


def _bins(title: str, df: DataFrame) -> str:
    rows = df.select("bin", "count").orderBy("bin").collect()
    return bars(title, [str(r["bin"]) for r in rows], [r["count"] for r in rows])


def _named(title: str, df: DataFrame, key: str, value: str = "count", top: int = 30) -> str:
    rows = df.orderBy(F.desc(value), key).limit(top).collect()
    return bars(title, [str(r[key]) for r in rows], [r[value] for r in rows])


def _dimensions(m: DataFrame) -> str:
    cells = plots.dimensions(m).collect()
    wide, high = max([1, *(c["x"] for c in cells)]), max([1, *(c["y"] for c in cells)])
    n = plots.CELLS
    return grid("Dimensions", [(min(n - 1, c["x"] * n // (wide + 1)), n - 1 - min(n - 1, c["y"] * n // (high + 1)), c["count"]) for c in cells], n)


#: The plots of a manifest.
PLOTS: dict[str, Callable[[DataFrame], str]] = {
    "dimensions": _dimensions,
    "file_size": lambda m: _bins("File sizes (log bins)", plots.file_size_histogram(m)),
    "aspect_ratio": lambda m: _bins("Aspect ratios", plots.aspect_ratio(m)),
    "brightness": lambda m: _bins("Brightness", plots.brightness(m)),
    "channels": lambda m: _named("Channel means", plots.channels(m), "channel", "mean"),
    "artifacts": lambda m: _bins("Corner to centre gap", plots.artifacts(m)),
    "duplicates": lambda m: _named("Groups by size", duplicates.group_sizes(m), "group_size", "groups"),
    "blur": lambda m: _bins("Blur scores", plots.blur(m)),
    "exif_camera": lambda m: _named("Cameras", plots.exif_camera(m), "camera"),
    "exif_focal_length": lambda m: _bins("Focal lengths", plots.exif_focal(m)),
    "exif_iso": lambda m: _bins("ISO", plots.exif_iso(m)),
}


def heat(title: str, names: Sequence[str], cells: dict[tuple[str, str], float]) -> str:
    """A matrix of named rows and columns as shades."""
    top, n = max([*cells.values(), 1]), max(len(names), 1)
    side, left = min((W - 3 * PAD) / n, (H - 2 * PAD) / n), 3 * PAD
    body = [f'<text x="{W / 2}" y="20" text-anchor="middle" font-size="14">{html.escape(title)}</text>']
    for i, a in enumerate(names):
        body.append(f'<text x="{left - 4}" y="{PAD + (i + 0.7) * side:.1f}" text-anchor="end" font-size="{min(10, side):.1f}">{html.escape(a)[:20]}</text>')
        for j, b in enumerate(names):
            v = cells.get((a, b), 0)
            body.append(f'<rect x="{left + j * side:.1f}" y="{PAD + i * side:.1f}" width="{side:.1f}" height="{side:.1f}" fill="#4878a8" fill-opacity="{v / top:.3f}"><title>{html.escape(a)}, {html.escape(b)}: {v:g}</title></rect>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {W} {H}" font-family="sans-serif">{"".join(body)}</svg>'


def scatter(title: str, points: Sequence[tuple[float, float, bool]]) -> str:
    """Points in two colours, the marked ones larger."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    sx, sy = (W - 2 * PAD) / ((max(xs) - min(xs)) or 1), (H - 2 * PAD) / ((max(ys) - min(ys)) or 1)
    marked = sum(m for *_, m in points)
    body = [f'<text x="{W / 2}" y="20" text-anchor="middle" font-size="14">{html.escape(title)}</text>', f'<text x="{W - PAD}" y="34" text-anchor="end" font-size="10">{len(points) - marked:,} normal, {marked:,} outliers</text>']
    body += [f'<circle cx="{PAD + (x - min(xs)) * sx:.1f}" cy="{H - PAD - (y - min(ys)) * sy:.1f}" r="{3 if m else 1.5}" fill="{"#c44e52" if m else "#4878a8"}" fill-opacity="{0.8 if m else 0.4}"/>' for x, y, m in sorted(points, key=lambda p: p[2])]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {W} {H}" font-family="sans-serif">{"".join(body)}</svg>'


def embedding_plot(projection: DataFrame, outliers: DataFrame, config: PlotConfig = PlotConfig()) -> str:
    """Projected vectors (path, x, y) with the outliers (path) marked, of so many as a scatter shows; returns its path."""
    marks = outliers.select("path").distinct().withColumn("outlier", F.lit(True))
    some = plots.sample_n(projection, config.sample or plots.SCATTER, config.seed)
    rows = some.join(marks, "path", "left").select("x", "y", F.coalesce("outlier", F.lit(False)).alias("outlier")).collect()
    return _written("embedding_projection", scatter("Embeddings", [tuple(r) for r in rows]), config)


def _written(name: str, svg: str, config: PlotConfig) -> str:
    if config.format != "svg":
        raise ValueError(f"plots are written as svg, not as {config.format}")
    os.makedirs(config.output_dir, exist_ok=True)
    path = os.path.join(config.output_dir, f"{name}.svg")
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg)
    return path


def plot(manifest: DataFrame, name: str, config: PlotConfig = PlotConfig()) -> str:
    """Write one plot; returns its path."""
    rows = manifest if config.sample is None or name == "duplicates" else plots.sample_n(plots.valid(manifest), config.sample, config.seed)
    return _written(name, PLOTS[name](rows), config)


def plot_all(manifest: DataFrame, config: PlotConfig = PlotConfig()) -> tuple[list[str], dict[str, str]]:
    """All plots; those that fail are returned with their error."""
    made, skipped = [], {}
    for name in PLOTS:
        try:
            made.append(plot(manifest, name, config))
        except Exception as e:  # noqa: BLE001 one plot must not end the others
            skipped[name] = str(e)
    return made, skipped


def annotation_plots(boxes: DataFrame, images: DataFrame) -> dict[str, str]:
    counts = annotations.class_counts(boxes, annotations.TOP)
    cells = annotations.heatmap(boxes).collect()
    names = [r["class_name"] for r in counts.orderBy(F.desc("count"), "class_name").limit(20).collect()]
    pairs = annotations.co_occurrence(boxes).filter(F.col("class_a").isin(names) & F.col("class_b").isin(names)).collect()  # 400 at most
    per_image = annotations.objects_per_image(boxes, images).orderBy("objects").limit(50).collect()
    return {
        "class_frequency": _named("Classes", counts, "class_name"),
        "bbox_sizes": _named("Box sizes", annotations.size_classes(boxes), "size_class"),
        "objects_per_image": bars("Objects per image", [str(r["objects"]) for r in per_image], [r["images"] for r in per_image]),
        "co_occurrence": heat("Classes together", names, {(r["class_a"], r["class_b"]): r["images"] for r in pairs}),
        "coverage": grid("Box centres", [(c["cell_x"], c["cell_y"], c["count"]) for c in cells], annotations.GRID),
    }


def report(manifest: DataFrame, path: str) -> str:
    """A page with the summary, formats, makes, flagged rows and all plots."""
    s = summary.summary(manifest).first().asDict()
    cards = "".join(f"<div class='card'><b>{v:,}</b><br>{html.escape(k.replace('_', ' '))}</div>" for k, v in s.items())

    def table(df: DataFrame, *columns: str) -> str:
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in columns) + "</tr>" for r in df.select(*columns).collect())
        return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + f"</tr>{rows}</table>"

    formats = table(summary.category_counts(manifest, "format").orderBy("rank"), "key", "count")
    makes = table(summary.category_counts(manifest, "camera_make").orderBy("rank").limit(MAKES), "key", "count")
    flagged = table(checks.flagged(manifest, FLAGGED), "path", "issues")
    figures = "".join(f"<figure>{make(manifest)}</figure>" for make in PLOTS.values())
    page = f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>Dataset report</title><style>body{{font-family:sans-serif;margin:2em}}.card{{display:inline-block;padding:8px 14px;margin:4px;border:1px solid #ccc}}table{{border-collapse:collapse}}td,th{{border:1px solid #ddd;padding:3px 8px;cursor:pointer}}figure{{display:inline-block;width:640px}}</style></head>
<body><h1>Dataset report</h1>{cards}<h2>Formats</h2>{formats}<h2>Camera makes</h2>{makes}<h2>Flagged</h2><input id="q" placeholder="filter">{flagged}<h2>Plots</h2>{figures}
<script>document.getElementById('q').oninput=e=>document.querySelectorAll('table:last-of-type tr').forEach((r,i)=>{{if(i)r.hidden=!r.textContent.includes(e.target.value)}});
document.querySelectorAll('th').forEach((h,i)=>h.onclick=()=>{{const t=h.closest('table'),k=h.cellIndex;[...t.rows].slice(1).sort((a,b)=>a.cells[k].textContent.localeCompare(b.cells[k].textContent,undefined,{{numeric:true}})).forEach(r=>t.tBodies[0].append(r))}})</script></body></html>"""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path
