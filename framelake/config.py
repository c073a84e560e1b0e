"""Settings of scans, plots and gates. Values are the documented defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif", ".webp")


@dataclass(frozen=True)
class ScanConfig:
    workers: int = 0
    checkpoint_every: int = 500
    include_hashes: bool = True
    hash_size: int = 16
    skip_exif: bool = False
    skip_pixel_stats: bool = False
    skip_blur: bool = False
    extensions: tuple[str, ...] = EXTENSIONS
    dark_threshold: float = 40.0
    overexposed_threshold: float = 220.0
    artifact_threshold: float = 50.0
    blur_threshold: float = 100.0
    duplicate_hamming_threshold: int = 8
    max_image_dimension: int = 2048
    #: Seconds for a file; what takes longer is corrupt.
    image_timeout: float = 60.0
    resume: bool = True
    force: bool = False

    @classmethod
    def of(cls, values: dict[str, Any]) -> ScanConfig:
        """Known keys of ``values``; others are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "extensions" else v for k, v in values.items() if k in known})

    def asdict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class PlotConfig:
    output_dir: str = "plots"
    format: str = "svg"
    sample: int | None = None
    seed: int = 42
    artifact_threshold: float = 50.0


@dataclass(frozen=True)
class Policy:
    max_corrupt_pct: float = 1.0
    max_overexposed_pct: float = 5.0
    max_underexposed_pct: float = 5.0
    max_duplicate_pct: float = 10.0
    max_blurry_pct: float = 100.0
    max_artifact_pct: float = 100.0
    min_images_total: int = 100
    min_width: int = 0
    min_height: int = 0
    max_aspect_ratio: float = 0.0
    allowed_formats: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, values: Any) -> Policy:
        """A policy from a parsed document; anything but a mapping gives the defaults."""
        if not isinstance(values, dict):
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v or ()) if k == "allowed_formats" else v for k, v in values.items() if k in known})

    @classmethod
    def load(cls, path: str) -> Policy:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f))


def extensions_of(text: str) -> tuple[str, ...]:
    """``"jpg, .png"`` as extensions with a leading dot."""
    return tuple("." + x.strip().lstrip(".") for x in text.split(",") if x.strip())
