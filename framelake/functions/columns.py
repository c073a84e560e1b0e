"""Native column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCOMPARABLE = 999


def word64(padded: Column, i: Column | int) -> Column:
    """The 64-bit word number ``i``, from the left, of a hexadecimal string."""
    at = F.lit(1) + F.lit(16) * i
    return F.conv(F.substr(padded, at, F.lit(16)), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings of any length, as numbers: the shorter has zeros before it; 999
    if either is none. Hashes of 16 and 64 digits have expressions of their own, others are walked."""
    valid = a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    words = F.ceil(F.greatest(F.length(a), F.length(b)) / 16).cast("int")

    def bits(n: int) -> Column:
        x, y = (F.lpad(h, 16 * n, "0") for h in (a, b))
        return sum((F.bit_count(word64(x, i).bitwiseXOR(word64(y, i))) for i in range(n)), F.lit(0))

    x, y = (F.lpad(h, words * 16, F.lit("0")) for h in (a, b))
    walked = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda s, i: s + F.bit_count(word64(x, i).bitwiseXOR(word64(y, i))))
    return F.when(~valid, F.lit(UNCOMPARABLE)).when(words <= 1, bits(1)).when(words <= 4, bits(4)).otherwise(walked).cast("int")


def words64(h: Column, n: int) -> Column:
    """The ``n`` 64-bit words of a hexadecimal string, as an array; null if it is none. Computed once a row, they make
    ``bits_apart`` of many pairs cheap."""
    padded = F.lpad(h, 16 * n, "0")
    return F.when(h.rlike("^[0-9a-fA-F]+$"), F.array(*[word64(padded, i) for i in range(n)]))


def bits_apart(x: Column, y: Column, n: int) -> Column:
    """Differing bits of two hashes given as ``n`` words."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(n)), F.lit(0)).cast("int")


def extension(filename: Column) -> Column:
    """Lower-case text after the last dot; null without a dot or after a trailing one."""
    ext = F.lower(F.substring_index(filename, ".", -1))
    return F.when(F.contains(filename, F.lit(".")) & (ext != ""), ext)


def camera_label(make: Column, model: Column) -> Column:
    """The model, after the make unless it begins with it; null without a model."""
    model, make = F.nullif(model, F.lit("")), F.nullif(make, F.lit(""))
    return F.when(make.isNotNull() & ~F.startswith(model, make), F.concat_ws(" ", make, model)).otherwise(model)


def distortion_risk(f35: Column) -> Column:
    return F.when(f35 < 18, "high").when(f35 < 24, "medium").when(f35.isNotNull(), "low")


def fixed2(x: Column) -> Column:
    """Two places, correctly rounded from the binary value: at a seeming tie the part that the product with
    100 lost (found by splitting the factor in two halves) decides."""
    p, c = x * 100.0, x * 134217729.0
    high = c - (c - x)
    lost = (high * 100.0 - p) + (x - high) * 100.0
    tie = p - F.floor(p) == 0.5
    hundredths = F.when(tie & (lost > 0), F.ceil(p)).when(tie & (lost < 0), F.floor(p)).otherwise(F.rint(p))
    return F.format_string("%.2f", hundredths / 100.0)


def fmt_bytes(n: Column) -> Column:
    """Decimal units, two places."""
    n = n.cast("double")
    return F.when(n > 1e9, F.concat(fixed2(n / 1e9), F.lit(" GB"))).when(n > 1e6, F.concat(fixed2(n / 1e6), F.lit(" MB"))).otherwise(F.concat(fixed2(n / 1e3), F.lit(" KB")))


def format_size(kb: Column) -> Column:
    """Kibibytes in a fitting binary unit: no place from 100, one from 10, else two, with thousands marks."""
    value = F.when(kb >= 1024.0 * 1024, kb / (1024.0 * 1024)).when(kb >= 1024, kb / 1024.0).otherwise(kb)
    unit = F.when(kb >= 1024.0 * 1024, "GB").when(kb >= 1024, "MB").otherwise("KB")
    number = F.when(value >= 100, F.format_number(value, 0)).when(value >= 10, F.format_number(value, 1)).otherwise(F.format_number(value, 2))
    return F.concat_ws(" ", number, unit)


def size_class(area: Column) -> Column:
    return F.when(area < 0.01, "small").when(area < 0.1, "medium").otherwise("large")


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, F.round(width.cast("double") / height, 4)).otherwise(F.lit(0.0))


def bin_of(v: Column, low: float, high: float, n: int) -> Column:
    """Bin 0 to n-1 of equal width; the last is closed. Equal ends are widened by half a unit."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return F.least(F.floor((v - F.lit(float(low))) / F.lit(float(high) - float(low)) * n), F.lit(n - 1)).cast("int")


def adaptive_bins(n: int, low: float, high: float) -> int:
    """Bins of a file-size histogram: by the root of the count, more for wide ranges."""
    bins = max(15, min(80, int(1.5 * n**0.5)))
    return min(100, int(bins * 1.3)) if low > 0 and high / low > 1000 else bins


def normalised_box(kind: str, iw: Column, ih: Column, a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Centre, size and area in shares of the image. ``coco``: left, top, width, height; ``voc``: two corners."""
    w, h = (c, d) if kind == "coco" else (c - a, d - b)
    zero = F.lit(0.0)
    nw, nh = F.when(iw > 0, w / iw).otherwise(zero), F.when(ih > 0, h / ih).otherwise(zero)
    return {"x": F.when(iw > 0, (a + w / 2) / iw).otherwise(zero), "y": F.when(ih > 0, (b + h / 2) / ih).otherwise(zero), "w": nw, "h": nh, "area": nw * nh}


def issues(*, corrupt: bool = True) -> Column:
    """Names of the flags of a row, joined in fixed order."""
    names = [("is_corrupt", "corrupt")] * corrupt + [("is_dark", "dark"), ("is_overexposed", "overexposed"), ("is_blurry", "blurry"), ("has_border_artifact", "artifact")]
    return F.concat_ws(", ", *[F.when(F.col(c), F.lit(n)) for c, n in names])
