"""Order statistics and histograms that no single task or the driver gathers in full."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bin_of

#: Bins of one round, and values that may be gathered once a bin is as small.
BINS, FEW = 4096, 10_000


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the ascending column. Each round counts values in bins and goes on
    in the bin that a rank lies in, until it holds a few values or one."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")

    def find(rows: DataFrame, ranks: list[int], offset: int, low: float, high: float, n: int) -> dict[int, float]:
        if low == high:
            return {r: low for r in ranks}
        if n <= FEW:
            held = sorted(x["v"] for x in rows.collect())
            return {r: held[r - offset] for r in ranks}
        counts = rows.groupBy(bin_of(F.col("v"), low, high, BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        out, upto = {}, offset
        for c in sorted(counts, key=lambda c: c["bin"]):
            if own := [r for r in ranks if upto <= r < upto + c["n"]]:
                out |= find(rows.filter((F.col("v") >= c["low"]) & (F.col("v") <= c["high"])), own, upto, c["low"], c["high"], c["n"])
            upto += c["n"]
        return out

    s = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    wanted = sorted({r for r in ranks if 0 <= r < s["n"]})
    return find(values, wanted, 0, s["low"], s["high"], s["n"]) if wanted else {}


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Percentiles with linear interpolation between neighbours; None for an empty column."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = order_statistics(df, column, [r for p in places for r in (math.floor(p), math.ceil(p))])
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def ends(df: DataFrame, column: str) -> tuple[int, float, float]:
    """Count, least and largest value; zeros for an empty column."""
    s = df.agg(F.count(column), F.min(column).cast("double"), F.max(column).cast("double")).first()
    return (s[0], s[1], s[2]) if s[0] else (0, 0.0, 0.0)


def histogram(df: DataFrame, column: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, bin_low, bin_high and count of the bins that hold values."""
    if low is None or high is None:
        _, low, high = ends(df, column)
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / n
    out = df.filter(F.col(column).isNotNull()).groupBy(bin_of(F.col(column), low, high, n).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("bin_low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("bin_high"), "count")
