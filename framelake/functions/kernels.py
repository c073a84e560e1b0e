"""Per-image kernels on numpy arrays, and header parsing on bytes."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

# EXIF tags.
TAGS = {
    0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation_tag", 0x829A: "exposure_time_sec", 0x829D: "f_number", 0x8827: "iso_speed",
    0x9003: "datetime_original", 0x920A: "focal_length_mm", 0xA405: "focal_length_35mm", 0xA434: "lens_model",
}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
TEXT = {"camera_make", "camera_model", "lens_model", "datetime_original"}
WHOLE = {"iso_speed", "focal_length_35mm", "orientation_tag"}
#: Bytes of a value of each TIFF type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def pixel_stats(rgb: np.ndarray) -> dict[str, float | int]:
    """Means and population deviations of the channels, mean brightness, least and largest value."""
    flat = rgb.reshape(-1, 3).astype(np.float64)
    mean, std = flat.mean(axis=0), flat.std(axis=0)
    out: dict[str, float | int] = {f"{n}_{c}": float(v[i]) for n, v in (("mean", mean), ("std", std)) for i, c in enumerate("rgb")}
    return out | {"mean_brightness": float(flat.mean()), "min_val": int(rgb.min()), "max_val": int(rgb.max())}


def corner_stats(rgb: np.ndarray) -> dict[str, float]:
    """Mean of four corner patches (a tenth of each side), the centre half and the border strips; their gap."""
    h, w = rgb.shape[:2]
    ph, pw = max(1, int(h * 0.1)), max(1, int(w * 0.1))
    x = rgb.astype(np.float64)
    rows, cols = (slice(None, ph), slice(h - ph, None)), (slice(None, pw), slice(w - pw, None))
    corner = float(np.mean([x[r, c].mean() for r in rows for c in cols]))
    centre = float(x[h // 4 : h - h // 4, w // 4 : w - w // 4].mean()) if h > 1 and w > 1 else float(x.mean())
    strips = [x[r].reshape(-1, 3) for r in rows] + [x[:, c].reshape(-1, 3) for c in cols]
    return {"corner_mean": corner, "center_mean": centre, "border_mean": float(np.concatenate(strips).mean()), "delta": abs(corner - centre)}


def blur_score(rgb: np.ndarray) -> float:
    """Variance of the Laplacian of the grey image; edges wrap around."""
    g = rgb.astype(np.float64).mean(axis=2)
    around = sum(np.roll(g, s, axis=a) for s in (1, -1) for a in (0, 1))
    return float((around - 4 * g).var())


def _weights(n: int, m: int, radius: float = 3.0) -> np.ndarray:
    """Windowed-sinc weights that resample ``n`` samples to ``m``, as a matrix."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    x = (np.arange(n)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < radius, np.sinc(x) * np.sinc(x / radius), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    x = image.astype(np.float64)
    x = np.tensordot(_weights(x.shape[0], height), x, axes=(1, 0))
    x = np.moveaxis(np.tensordot(_weights(x.shape[1], width), x, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def bounded(rgb: np.ndarray, side: int) -> np.ndarray:
    """The image, reduced so that neither side exceeds ``side``."""
    h, w = rgb.shape[:2]
    if max(h, w) <= side:
        return rgb
    scale = side / max(h, w)
    return resize(rgb, max(1, int(h * scale)), max(1, int(w * scale)))


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of ITU-R BT.601."""
    return np.clip(np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def phash(rgb: np.ndarray, size: int = 16) -> str:
    """Low frequencies of a cosine transform against their median; ``size`` squared bits as hexadecimal."""
    n = 4 * size
    k = np.cos(np.pi * np.outer(np.arange(size), 2 * np.arange(n) + 1) / (2 * n))
    low = k @ resize(grey(rgb)[..., None], n, n)[..., 0].astype(np.float64) @ k.T
    return _hex(low > np.median(low))


def dhash(rgb: np.ndarray, size: int = 16) -> str:
    """Signs of horizontal differences."""
    small = resize(grey(rgb)[..., None], size, size + 1)[..., 0].astype(np.int16)
    return _hex(small[:, 1:] > small[:, :-1])


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels of Spark's image rows, which are BGR, BGRA or grey."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else np.ascontiguousarray(x[..., 2::-1])


def header(data: bytes) -> dict[str, Any]:
    """format, width, height, color_mode and num_channels by magic bytes; empty where unknown."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        w, h, depth, kind = struct.unpack(">IIBB", data[16:26])
        mode = {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "")
        return _described("PNG", w, h, mode)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
                return _described("JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(n, ""))
            if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD9:
                at += 1 if marker == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return {}
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return _described("GIF", *struct.unpack("<HH", data[6:10]), "P")
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return _described("BMP", w, abs(h), {1: "1", 8: "P", 24: "RGB", 32: "RGB"}.get(bits, ""))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            w, h = (1 + int.from_bytes(data[i : i + 3], "little") for i in (24, 27))
            return _described("WEBP", w, h, "RGBA" if data[20] & 0x10 else "RGB")
        if kind == b"VP8L":
            b = int.from_bytes(data[21:25], "little")
            return _described("WEBP", 1 + (b & 0x3FFF), 1 + (b >> 14 & 0x3FFF), "RGBA" if b >> 28 & 1 else "RGB")
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return _described("WEBP", w & 0x3FFF, h & 0x3FFF, "RGB")
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        tags = _ifd(data, 0, "<" if data[:2] == b"II" else ">", struct.unpack(("<" if data[:2] == b"II" else ">") + "I", data[4:8])[0])
        if 0x100 in tags and 0x101 in tags:
            n = int(_first(tags.get(0x115, 1)))
            return _described("TIFF", int(_first(tags[0x100])), int(_first(tags[0x101])), {1: "L", 3: "RGB", 4: "RGBA"}.get(n, ""))
    return {}


def _described(kind: str, w: int, h: int, mode: str) -> dict[str, Any]:
    bands = {"": 0, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4}.get(mode, 1)
    return {"format": kind, "width": w, "height": h, "color_mode": mode, "num_channels": bands}


def _first(v: Any) -> Any:
    return v[0] if isinstance(v, (list, tuple)) else v


def _ifd(data: bytes, base: int, order: str, at: int) -> dict[int, Any]:
    """Tags of a directory; damaged entries are left out."""
    out: dict[int, Any] = {}
    try:
        (n,) = struct.unpack_from(order + "H", data, base + at)
    except struct.error:
        return out
    for i in range(n):
        try:
            tag, kind, count = struct.unpack_from(order + "HHI", data, base + at + 2 + 12 * i)
            size = SIZES.get(kind, 0) * count
            place = base + at + 10 + 12 * i
            if size > 4:
                place = base + struct.unpack_from(order + "I", data, place)[0]
            raw = data[place : place + size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                out[tag] = raw.decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                values = [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
                out[tag] = values if count > 1 else values[0]
            elif kind == 7:
                out[tag] = raw
            else:
                values = struct.unpack(order + {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}[kind] * count, raw)
                out[tag] = list(values) if count > 1 else values[0]
        except struct.error:
            continue
    return out


def _text(v: Any) -> str | None:
    return (str(v).strip().rstrip("\x00").strip() or None) if v is not None else None


def _number(v: Any, whole: bool) -> float | int | None:
    try:
        x = int(_first(v)) if whole else float(_first(v))
    except (TypeError, ValueError, OverflowError):
        return None
    return x if whole or x > 0 else None


def exif(data: bytes) -> dict[str, Any]:
    """Camera fields of a JPEG's or TIFF's EXIF block: the first directory, then the EXIF one."""
    at = 0
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\x00\x00", 0, 1 << 17) + 6
        if at < 6:
            return {}
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = data.find(b"eXIf", 0, 1 << 17) + 4
        if at < 4:
            return {}
    mark = data[at : at + 4]
    if mark not in (b"II*\x00", b"MM\x00*"):
        return {}
    order = "<" if mark[:2] == b"II" else ">"
    try:
        first = _ifd(data, at, order, struct.unpack_from(order + "I", data, at + 4)[0])
    except struct.error:
        return {}
    more = _ifd(data, at, order, first[EXIF_IFD]) if isinstance(first.get(EXIF_IFD), int) else {}
    out: dict[str, Any] = {}
    for tag, name in TAGS.items():
        v = first.get(tag, more.get(tag))
        if v is not None:
            out[name] = _text(v) if name in TEXT else _number(v, name in WHOLE)
    out["has_gps_data"] = GPS_IFD in first
    return out
