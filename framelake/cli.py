"""Command line: python -m framelake.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__
from .config import PlotConfig, Policy, ScanConfig, extensions_of
from .engine import Engine, run_jobs
from .operators.rendering import PLOTS
from .sources.formats import detect, selected_dirs

SHOWN = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framelake")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("scan")
    c.add_argument("dir")
    c.add_argument("-o", "--output", default="./manifest")
    c.add_argument("--extensions")
    c.add_argument("--workers", type=int, default=0, help="kept for scripts; the session's cores work")
    c.add_argument("--checkpoint-every", type=int, default=500)
    c.add_argument("--no-resume", action="store_true")
    c.add_argument("--timeout", type=float, default=60.0)
    c.add_argument("--splits", help="of a dataset's layout, the splits to scan")
    for flag in ("force", "no-hashes", "skip-exif", "skip-pixel-stats", "skip-blur"):
        c.add_argument(f"--{flag}", action="store_true")
    for name, default in (("dark", 40.0), ("overexposed", 220.0), ("artifact", 50.0), ("blur", 100.0)):
        c.add_argument(f"--{name}-threshold", type=float, default=default)
    c.add_argument("--max-image-dim", type=int, default=2048)
    c.add_argument("--hash-size", type=int, default=16)
    for name in ("info", "report", "gate", "export", "plot", "check"):
        c = sub.add_parser(name)
        c.add_argument("-m", "--manifest", required=True, nargs="+" if name == "check" else None)
        if name in ("report", "export", "plot", "check"):
            c.add_argument("-o", "--output")
        if name == "gate":
            c.add_argument("-p", "--policy")
            c.add_argument("-o", "--output")
        if name == "export":
            c.add_argument("kind", choices=("csv", "parquet"))
        if name == "plot":
            c.add_argument("name", choices=(*PLOTS, "all"))
        if name == "check":
            c.add_argument("what", choices=("corrupt", "exposure", "artifacts", "duplicates", "blur", "leakage", "all"))
            c.add_argument("--threshold", type=int, default=8)
    c = sub.add_parser("diff")
    c.add_argument("--old", required=True)
    c.add_argument("--new", required=True)
    c.add_argument("-o", "--output")
    c = sub.add_parser("embed")
    c.add_argument("-m", "--manifest", required=True)
    c.add_argument("-r", "--root", required=True, help="folder of the images")
    c.add_argument("-o", "--output", default="./embeddings.parquet")
    c.add_argument("--encoder", help="module:function that gives a loader of an encoder")
    c.add_argument("--model", default="ViT-B-32")
    c.add_argument("--pretrained", default="laion2b_s34b_b79k")
    c.add_argument("--device")
    c.add_argument("--no-plot", action="store_true")
    c.add_argument("--plot-dir", default="./plots")
    c = sub.add_parser("jobs")
    c.add_argument("dir")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--batch-size", type=int, default=20)
    c = sub.add_parser("annotations")
    c.add_argument("dir")
    c.add_argument("-o", "--output")
    c.add_argument("--format", choices=("yolo", "coco", "voc"))
    return p


def put(found, output: str | None) -> None:
    """A result as JSON, to a file or to be read."""
    text = json.dumps(found, indent=2, default=str)
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def encoder(a):
    """The encoder's loader that the arguments name."""
    import importlib

    from .operators.embeddings import clip

    if not a.encoder:
        return clip(a.model, a.pretrained, a.device)
    module, _, name = a.encoder.partition(":")
    return getattr(importlib.import_module(module), name)


def show(df, output: str | None = None) -> None:
    """The first rows, or all of them as JSON lines."""
    if output:
        df.write.mode("overwrite").json(output)
    else:
        for line in df.limit(SHOWN).toJSON().collect():
            print(line)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: wrong use or nothing to work on; 2: the gate failed."""
    a = parser().parse_args(argv)
    e = Engine()
    if a.command == "scan":
        config = ScanConfig(extensions=extensions_of(a.extensions) if a.extensions else ScanConfig().extensions, force=a.force, workers=a.workers, checkpoint_every=a.checkpoint_every, resume=not a.no_resume, image_timeout=a.timeout, include_hashes=not a.no_hashes, skip_exif=a.skip_exif, skip_pixel_stats=a.skip_pixel_stats, skip_blur=a.skip_blur, dark_threshold=a.dark_threshold, overexposed_threshold=a.overexposed_threshold, artifact_threshold=a.artifact_threshold, blur_threshold=a.blur_threshold, max_image_dimension=a.max_image_dim, hash_size=a.hash_size)
        if a.splits:
            dirs = selected_dirs(detect(a.dir), [x.strip() for x in a.splits.split(",")])
            found = [e.scan(d, f"{a.output}/{os.path.basename(d)}" if len(dirs) > 1 else a.output, config) for d in dirs]
            n, bad = (sum(x) for x in zip(*found, strict=True)) if found else (0, 0)
        else:
            n, bad = e.scan(a.dir, a.output, config)
        print(json.dumps({"images": n, "corrupt": bad}))
    elif a.command == "info":
        found = e.info(a.manifest)
        print(json.dumps(found, indent=2))
        return 0 if found["total_images"] else 1
    elif a.command == "report":
        print(e.report(a.manifest, a.output or "./report.html"))
    elif a.command == "gate":
        good, found = e.gate(a.manifest, Policy.load(a.policy) if a.policy else Policy())
        if a.output:
            put({"passed": good, "rules": [r.asDict() for r in found.orderBy("ord").collect()]}, a.output)
        show(found.orderBy("ord"))
        return 0 if good else 2
    elif a.command == "export":
        print(e.export(a.manifest, a.kind, a.output or f"./manifest.{a.kind}"))
    elif a.command == "plot":
        print("\n".join(e.plot(a.manifest, a.name, PlotConfig(output_dir=a.output or "plots"))))
    elif a.command == "check":
        if a.what == "leakage":
            if len(set(a.manifest)) < 2:
                print("leakage needs two manifests", file=sys.stderr)
                return 1
            show(e.leakage({m: m for m in a.manifest}, a.threshold), a.output)
        else:
            show(e.check(a.manifest[0], a.what), a.output)
    elif a.command == "diff":
        rows, totals = e.diff(a.old, a.new)
        if a.output:  # the changes may be many: a folder of JSON lines, with the totals beside
            rows.filter("status <> 'unchanged'").write.mode("overwrite").json(f"{a.output}/changes")
            totals.write.mode("overwrite").json(f"{a.output}/summary")
        show(totals)
        show(rows.filter("status <> 'unchanged'").orderBy("path"))
    elif a.command == "annotations":
        put(e.annotation_report(a.dir, a.format), a.output)
    elif a.command == "jobs":
        found = run_jobs(e, a.dir, a.output, a.batch_size)
        put(found, None)
        return 0 if found["status"] == 200 else 1
    elif a.command == "embed":
        try:
            load = encoder(a)
        except ImportError as error:
            print(error, file=sys.stderr)
            return 1
        vectors = e.embed(a.manifest, a.root, load)
        vectors.write.mode("overwrite").parquet(a.output)
        vectors = e.spark.read.parquet(a.output)
        n = vectors.count()
        if not n:
            print("no valid images", file=sys.stderr)
            return 1
        put({"images": n, "output": a.output} | e.embedding_report(vectors, None if a.no_plot else a.plot_dir), None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
