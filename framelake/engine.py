"""The library's front: one object for a session, and the jobs of the map-and-reduce pipeline."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PlotConfig, Policy, ScanConfig
from .operators import annotations, checks, diff, duplicates, embeddings, gate, leakage, rendering, summary
from .operators.graph import cut
from .sources import formats, images, labels
from .sources import manifest as files


class Engine:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    def read(self, path: str) -> DataFrame:
        """Records of a manifest: Parquet if it has such files, else JSON lines."""
        if path.endswith(".parquet"):
            return self.spark.read.parquet(path)
        return files.read_jsonl(self.spark, path)[1]

    def scan(self, root: str, output: str, config: ScanConfig = ScanConfig()) -> tuple[int, int]:
        return images.run_scan(self.spark, root, output, config)

    def info(self, path: str) -> dict[str, Any]:
        rows = self.read(path)
        out = summary.summary(rows).first().asDict()
        counts = summary.all_category_counts(rows).orderBy("dimension", "rank").collect()
        for d in summary.DIMENSIONS:
            out[f"{d}_counts"] = {c["key"]: c["count"] for c in counts if c["dimension"] == d}
        return out

    def check(self, path: str, what: str) -> DataFrame:
        rows = self.read(path)
        if what == "duplicates":
            near = duplicates.near_clusters(rows).join(rows.select("row_idx", "path"), "row_idx").select(F.lit("near").alias("kind"), F.col("cluster").cast("string").alias("group"), "path")
            return duplicates.members(rows).select(F.lit("exact").alias("kind"), F.col("phash").alias("group"), "path").unionByName(near)
        return {"corrupt": checks.corrupt, "exposure": checks.exposure, "artifacts": checks.artifacts, "blur": checks.blur, "all": checks.everything}[what](rows)

    def leakage(self, manifests: dict[str, str], threshold: int = leakage.THRESHOLD) -> DataFrame:
        """Leaks between manifests by split label."""
        rows = leakage.with_splits({name: self.read(p) for name, p in manifests.items()})
        return leakage.report(rows, list(manifests), threshold)

    def diff(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        a, b = self.read(old), self.read(new)
        return diff.joined(a, b), diff.summary(a, b)

    def gate(self, path: str, policy: Policy = Policy()) -> tuple[bool, DataFrame]:
        found = gate.report(self.read(path), policy)
        return found.agg(F.every("passed")).first()[0], found

    def annotations(self, root: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Boxes and images of a labelled folder."""
        info = formats.detect(root)
        kind = kind or info.format
        if kind == "yolo":
            return labels.yolo(self.spark, info.annotation_path or root, info.class_names)[:2]
        if kind == "coco":
            return labels.coco(self.spark, info.annotation_path or root)[:2]
        if kind == "voc":
            return labels.voc(self.spark, info.annotation_path or root)[:2]
        raise ValueError(f"no labels in the layout {kind}")

    def annotation_report(self, root: str, kind: str | None = None) -> dict[str, Any]:
        boxes, held = self.annotations(root, kind)
        out = annotations.stats(boxes, held).first().asDict()
        out["class_counts"] = {r["class_name"]: r["count"] for r in annotations.class_counts(boxes).orderBy("rank").collect()}
        out |= {f"{r['size_class']}_count": r["count"] for r in annotations.size_classes(boxes).collect()}
        out["orphan_images"] = [r["image"] for r in annotations.unannotated(boxes, held).orderBy("image").limit(20).collect()]
        return out

    def embed(self, path: str, root: str, load: Callable) -> DataFrame:
        """Embeddings of the rows that aren't corrupt and whose files, below ``root``, exist."""
        rows = self.read(path).filter("not is_corrupt").select("path")
        held = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        return embeddings.compute(held.join(rows, "path", "left_semi"), load)

    def embedding_report(self, vectors: DataFrame, plot_dir: str | None = None) -> dict[str, Any]:
        """Outliers of stored vectors (path, embedding): their number, the first ten, and the scatter plot's path."""
        out = embeddings.outliers(vectors, id_col="path")
        found: dict[str, Any] = {"outliers": out.count(), "first": [r["path"] for r in out.orderBy("path").limit(10).collect()]}
        if plot_dir:
            found["plot"] = rendering.embedding_plot(embeddings.project(vectors, id_col="path"), out, PlotConfig(output_dir=plot_dir))
        return found

    def report(self, path: str, output: str) -> str:
        return rendering.report(self.read(path), output)

    def plot(self, path: str, name: str, config: PlotConfig = PlotConfig()) -> list[str]:
        rows = self.read(path)
        return rendering.plot_all(rows, config)[0] if name == "all" else [rendering.plot(rows, name, config)]

    def export(self, path: str, kind: str, output: str) -> int:
        rows = files.conformed(self.read(path))
        if kind == "csv":
            return files.to_csv(rows, output)
        files.to_parquet(rows, output)
        return rows.count()


def run_jobs(engine: Engine, root: str, output: str, batch_size: int = 20, config: dict[str, Any] | None = None) -> dict[str, Any]:
    """The jobs in their order: list, analyse each batch, merge, aggregate, plot. A failing job ends the chain with
    its name and error; batches that were analysed by an earlier run are not analysed again."""
    done: dict[str, Any] = {}

    def job(**event: Any) -> dict[str, Any]:
        found = handle(engine, event)
        if found["status"] != 200:
            raise RuntimeError(found["error"])
        done[event["action"]] = found
        return found

    at = "list_images"
    try:
        n = job(action=at, root=root, batch_size=batch_size, output=f"{output}/batches")["batches"]
        at, parts = "analyze_batch", [f"{output}/partials/{k}" for k in range(n)]
        for k, part in enumerate(parts):
            if not files.exists(engine.spark, f"{part}/meta/_SUCCESS"):
                job(action=at, batches=f"{output}/batches", batch=k, output=part, root=root, config=config or {})
        at = "merge_manifests"
        job(action=at, parts=parts, output=f"{output}/manifest", root=root)
        at = "aggregate"
        job(action=at, manifest=f"{output}/manifest")
        at = "generate_plots"
        job(action=at, manifest=f"{output}/manifest", output=f"{output}/plots")
    except Exception as e:  # noqa: BLE001 the state says which job failed
        return {"status": 500, "failed": at, "error": str(e)[:500]} | done
    return {"status": 200} | done


#: Actions of the pipeline of jobs: list, analyse, merge, aggregate, plot.
def handle(engine: Engine, event: dict[str, Any]) -> dict[str, Any]:
    """Run the job that ``event['action']`` names; an unknown one gives the status 400."""
    action = str(event.get("action", "")).lower()
    spark = engine.spark
    if action == "list_images":
        keys = images.distributed_listing(spark, event["root"]).withColumn("row_idx", F.monotonically_increasing_id())
        dealt = files.batches(keys.select("row_idx", "path"), event.get("batch_size", 20))
        if "output" in event:
            dealt.write.mode("overwrite").parquet(event["output"])
            dealt = spark.read.parquet(event["output"])
        return {"status": 200, "batches": dealt.agg(F.count_distinct("batch")).first()[0], "keys": event.get("output")}
    if action == "analyze_batch":
        keys = event.get("keys")
        if keys is None:  # the numbered batch of a listing; it has batch_size keys
            keys = [r["path"] for r in spark.read.parquet(event["batches"]).filter(F.col("batch") == event["batch"]).orderBy("row_idx").collect()]
        with images.small_batches(spark):
            made = cut(images.scan_keys(spark, keys, ScanConfig.of(event.get("config", {}))))
        files.write_jsonl(made, event["output"], {"input_dir": event.get("root", "")})
        bad = made.filter("is_corrupt").count()
        return {"status": 200, "processed": len(keys) - bad, "errors": bad, "output": event["output"]}
    if action == "merge_manifests":
        return {"status": 200} | files.merge_files(spark, event["parts"], event["output"], {"input_dir": event.get("root", "")})
    if action == "aggregate":
        return {"status": 200, "summary": json.loads(summary.summary(engine.read(event["manifest"])).toJSON().first())}
    if action == "generate_plots":
        made, skipped = rendering.plot_all(engine.read(event["manifest"]), PlotConfig(output_dir=event["output"]))
        return {"status": 200, "plots": made, "skipped": skipped}
    return {"status": 400, "error": f"unknown action {action!r}"}
