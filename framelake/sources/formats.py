"""Dataset layout of a folder: YOLO, COCO, VOC, classification folders, or flat."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from ..config import EXTENSIONS

SPLITS = ("train", "val", "test")
FIRST_NAMES, FEWEST_CLASSES, WITH_IMAGES, MEASURED = 10, 3, 0.5, 100


@dataclass
class DatasetInfo:
    format: str
    root: str
    image_dirs: list[str] = field(default_factory=list)
    annotation_path: str | None = None
    num_images: int = 0
    num_classes: int = 0
    class_names: list[str] = field(default_factory=list)
    splits: dict[str, int] = field(default_factory=dict)
    size_bytes: int = 0

    def shown_names(self) -> list[str]:
        return self.class_names[:FIRST_NAMES]


def selected_dirs(info: DatasetInfo, splits: list[str]) -> list[str]:
    """The image folders named like the splits that were chosen; all where none is or none fits."""
    chosen = [d for d in info.image_dirs if Path(d).name in splits] if info.splits else []
    return chosen or info.image_dirs


def images_in(root: Path) -> list[Path]:
    return [p for p in root.rglob("*") if p.suffix.lower() in EXTENSIONS and p.is_file()] if root.is_dir() else []


def estimated_size(paths: list[Path]) -> int:
    some = [p.stat().st_size for p in paths[:MEASURED]]
    return int(sum(some) / len(some) * len(paths)) if some else 0


def _info(kind: str, root: Path, **more) -> DatasetInfo:
    found = images_in(root)
    return DatasetInfo(kind, str(root), num_images=len(found), size_bytes=estimated_size(found), **more)


def _yaml(path: Path) -> dict:
    import yaml

    try:
        held = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, ValueError, yaml.YAMLError):
        return {}
    return held if isinstance(held, dict) else {}


def _yolo(root: Path) -> DatasetInfo | None:
    held = next((h for n in ("data.yaml", "data.yml") if (h := _yaml(root / n))), None)
    if not held:
        return None
    names = held.get("names")
    names = [str(v) for v in (names.values() if isinstance(names, dict) else names)] if isinstance(names, (dict, list)) else []
    splits, dirs = {}, []
    for s in SPLITS:
        options = [root / held[s]] if isinstance(held.get(s), str) else []
        for d in [*options, root / "images" / s]:
            if n := len(images_in(d)):
                splits[s] = n
                dirs.append(str(d))
                break
    nc = held.get("nc")
    return _info("yolo", root, image_dirs=dirs, annotation_path=str(root / "labels"), num_classes=len(names) or (nc if isinstance(nc, int) else 0), class_names=names, splits=splits)


def _coco(root: Path) -> DatasetInfo | None:
    found, names = {}, []
    for p in sorted([*root.glob("*.json"), *root.glob("annotations/*.json")]):
        try:
            held = json.loads(p.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if isinstance(held, dict) and "images" in held and "annotations" in held:
            found[p] = len(held["images"])
            names = names or [str(c.get("name", c.get("id"))) for c in held.get("categories", [])]
    if not found:
        return None
    splits = {s: n for p, n in found.items() for s in SPLITS if s in p.stem.lower()}
    return _info("coco", root, image_dirs=[str(root)], annotation_path=str(next(iter(found))), num_classes=len(names), class_names=names, splits=splits)


def _voc(root: Path) -> DatasetInfo | None:
    if not list((root / "Annotations").glob("*.xml")) or not (root / "JPEGImages").is_dir():
        return None
    splits = {}
    for s in (*SPLITS, "trainval"):
        listed = root / "ImageSets" / "Main" / f"{s}.txt"
        if listed.is_file():
            splits[s] = sum(1 for x in listed.read_text().splitlines() if x.strip())
    return _info("voc", root, image_dirs=[str(root / "JPEGImages")], annotation_path=str(root / "Annotations"), splits=splits)


def _classification(root: Path) -> DatasetInfo | None:
    if (root / "labels").is_dir() or (root / "annotations").is_dir():
        return None
    dirs = sorted(d for d in root.iterdir() if d.is_dir() and not d.name.startswith("."))
    held = {d.name: n for d in dirs if (n := len(images_in(d)))}
    if len(dirs) < FEWEST_CLASSES or len(held) < WITH_IMAGES * len(dirs):
        return None
    return _info("classification", root, image_dirs=[str(root / d) for d in held], num_classes=len(held), class_names=list(held), splits=held)


def detect(root: str) -> DatasetInfo:
    """The first layout that fits, by the order above. Metadata only: it runs on the driver."""
    at = Path(root)
    if not at.is_dir():
        raise NotADirectoryError(root)
    for probe in (_yolo, _coco, _voc, _classification):
        if (info := probe(at)) is not None:
            return info
    return _info("flat", at, image_dirs=[os.fspath(at)])
