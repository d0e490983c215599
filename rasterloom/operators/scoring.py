"""Whether rasters suit tracing, from counts of their transitions, as Column expressions over one row an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.kernel.analysis import MOST_COLOURS, SMALL_SIDES, VERDICTS


def ratios(edges: DataFrame, *keep: str) -> DataFrame:
    """``flat_ratio, soft_ratio, hard_ratio, transparent_ratio, colors`` from the counts of ``pixels.edges``."""
    n = F.greatest(F.lit(1), F.col("opaque"))
    shares = [(F.col(c) / n).alias(f"{c}_ratio") for c in ("flat", "soft", "hard")]
    return edges.select(*keep, *shares, (F.col("transparent") / (F.col("opaque") + F.col("transparent"))).alias("transparent_ratio"), "colors")


def classified(m: DataFrame, width: Column, height: Column) -> DataFrame:
    """``m(flat_ratio, soft_ratio, colors)`` with classification, score and suitability."""
    flat, soft, colors, capped = F.col("flat_ratio"), F.col("soft_ratio"), F.col("colors"), F.col("colors") >= MOST_COLOURS
    kind = (
        F.when((flat < 0.2) & (soft > 0.55) | capped & (flat < 0.35), "photo")
        .when((flat >= 0.6) & (colors <= 8), "line-art").when(flat >= 0.6, "flat-art")
        .when((flat >= 0.3) & ((soft > 0.45) | (colors > 4000)), "gradient-art").when(flat >= 0.3, "flat-art")
        .when(soft > 0.4, "gradient-art").otherwise("unknown")
    )
    r = lambda c: F.floor(c + 0.5)
    k, short, off, verdict = F.col("classification"), F.least(width, height), F.lit(0), F.lit("poor")
    base = F.when(k == "line-art", 92).when(k == "flat-art", 70 + r(flat * 25)).when(k == "gradient-art", 45 + r(flat * 25) - r(soft * 15)).when(k == "photo", 12).otherwise(45)
    for side, points in reversed(SMALL_SIDES):
        off = F.when(short < side, points).otherwise(off)
    for least, name in reversed(VERDICTS):
        verdict = F.when(F.col("score") >= least, name).otherwise(verdict)
    score = F.greatest(F.lit(0), F.least(F.lit(100), base - off - F.when(capped & (k != "photo"), 8).otherwise(0)))
    return m.withColumn("classification", kind).withColumn("score", score.cast("int")).withColumn("suitability", verdict)
