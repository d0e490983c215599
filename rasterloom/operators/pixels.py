"""Pixels as relations: alpha, scaling, median, noise, edges, histograms, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators.labels import along_column, along_row, scatter

MOST_ENTRIES = 256  #: entries of a palette, which is broadcast


def harden_alpha(px: DataFrame, least: int = 128) -> DataFrame:
    return px.withColumn("a", F.when(F.col("a") >= least, 255).otherwise(0))


def opaque(px: DataFrame, least: int = 128) -> DataFrame:
    return px.where(F.col("a") >= least)


def downscale(px: DataFrame, width: int, height: int, most: int) -> DataFrame:
    """``image_id, x, y, r, g, b, a`` averaged by area to ``most`` pixels a side, colours weighted by alpha."""
    if max(width, height) <= most:
        return px.select("image_id", "x", "y", "r", "g", "b", "a")
    scale = most / max(width, height)
    ow, oh = max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))

    def cells(c: str, size: int, out: int):
        # A source pixel lies in the output cells o with floor(o * ratio) <= c < max(floor(o * ratio) + 1, ceil((o + 1) * ratio)).
        ratio, first = size / out, F.floor(F.col(c) / (size / out)) - 1
        low = lambda o: F.floor(o * F.lit(ratio))
        holds = lambda o: (o >= 0) & (o < out) & (low(o) <= F.col(c)) & (F.col(c) < F.greatest(low(o) + 1, F.ceil((o + 1) * F.lit(ratio))))
        return F.explode(F.filter(F.sequence(first, first + 2), holds))

    wide = px.select("*", cells("x", width, ow).alias("ox"))
    out = wide.select("*", cells("y", height, oh).alias("oy")).groupBy("image_id", "ox", "oy").agg(
        *(F.sum(F.col(c) * F.col("a")).alias(f"s{c}") for c in "rgb"), F.sum("a").alias("sa"), F.count(F.lit(1)).alias("n")
    )
    mean = lambda c: F.when(F.col("sa") == 0, 0).otherwise(F.floor(F.col(f"s{c}") / F.col("sa") + 0.5)).cast("int").alias(c)
    return out.select("image_id", F.col("ox").cast("int").alias("x"), F.col("oy").cast("int").alias("y"), *map(mean, "rgb"), F.floor(F.col("sa") / F.col("n") + 0.5).cast("int").alias("a"))


def median(px: DataFrame, width: int, height: int, radius: int = 1) -> DataFrame:
    """``image_id, x, y, r, g, b, a``: upper median of each channel over the visible pixels of the clipped window."""
    seen = scatter(px, radius, ["r", "g", "b", "a"], width, height)
    here = (F.col("dx") == 0) & (F.col("dy") == 0)
    visible = F.col("a") > 0
    aggs = [F.sort_array(F.collect_list(F.when(visible, F.col(c)))).alias(f"m{c}") for c in "rgb"] + [F.max(F.when(here, F.col(c))).alias(c) for c in "rgba"]
    out = seen.groupBy("image_id", "x", "y").agg(*aggs)
    pick = lambda c: F.when(F.col("a") == 0, F.col(c)).otherwise(F.element_at(F.col(f"m{c}"), (F.floor(F.size(f"m{c}") / 2) + 1).cast("int"))).alias(c)
    return out.select("image_id", "x", "y", *map(pick, "rgb"), "a")


def noise(px: DataFrame, width: int, height: int) -> DataFrame:
    """``image_id, flat_samples, overshoot_samples, noise`` of each image (up to half a megapixel: every pixel)."""
    step = 2 if width * height > 500_000 else 1
    inner = scatter(px, 1, ["r", "g", "b", "a"], width - 1, height - 1).where("x >= 1 AND y >= 1")
    inner = inner.where(f"(x - 1) % {step} = 0 AND (y - 1) % {step} = 0")
    at = lambda dx, dy, c: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(c)))
    luma = color.luma(F.col("r"), F.col("g"), F.col("b"))
    ring = (F.col("dx") != 0) | (F.col("dy") != 0)
    cells = inner.groupBy("image_id", "x", "y").agg(
        F.min("a").alias("least_a"), F.min(F.least("r", "g", "b")).alias("low"), F.max(F.greatest("r", "g", "b")).alias("high"),
        F.min(F.when(ring, luma)).alias("luma_low"), F.max(F.when(ring, luma)).alias("luma_high"), F.max(F.when(~ring, luma)).alias("luma"),
        *(at(dx, 0, c).alias(f"{c}{dx + 1}") for c in "rgb" for dx in (-1, 0, 1)),
    ).where("least_a >= 250")
    off = lambda c: F.abs(F.col(f"{c}1") - F.element_at(F.sort_array(F.array(f"{c}0", f"{c}1", f"{c}2")), 2))
    flat = F.col("high") - F.col("low") <= 24
    over = (F.col("luma") > F.col("luma_high") + 4) | (F.col("luma") < F.col("luma_low") - 4)
    sums = cells.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("overshoot_samples"), F.sum(over.cast("bigint")).alias("overshoots"), F.sum(F.when(flat, 3).otherwise(0)).alias("flat_samples"), F.sum(F.when(flat, off("r") + off("g") + off("b")).otherwise(0)).alias("deviation")
    )
    signal = F.when(F.col("flat_samples") > 0, F.col("deviation") / F.col("flat_samples") / 12 / 0.02).otherwise(0.0)
    return sums.select("image_id", "flat_samples", "overshoot_samples", "overshoots", "deviation", F.least(F.lit(1.0), F.greatest(signal, F.col("overshoots") / F.col("overshoot_samples") / 0.006)).alias("noise"))


def edges(px: DataFrame, step: int = 1) -> DataFrame:
    """``image_id, opaque, transparent, flat, soft, hard, colors``: transitions of the sampled pixels, by the larger of right and down."""
    c = F.struct("r", "g", "b")
    right, down = F.lead(c).over(along_row()), F.lead(c).over(along_column())
    jump = lambda n: F.coalesce(F.greatest(*(F.abs(F.col(k) - n[k]) for k in "rgb")), F.lit(0))
    seen = px.withColumn("right", right).withColumn("down", down).where(f"x % {step} = 0 AND y % {step} = 0").withColumn("d", F.greatest(jump(F.col("right")), jump(F.col("down"))))
    on = F.col("a") >= 128
    n = lambda cond: F.count_if(on & cond)
    return seen.groupBy("image_id").agg(
        F.count_if(on).alias("opaque"), F.count_if(~on).alias("transparent"), n(F.col("d") == 0).alias("flat"), n((F.col("d") > 0) & (F.col("d") <= 10)).alias("soft"), n(F.col("d") >= 40).alias("hard"),
        F.count_distinct(F.when(on, color.pack24(F.col("r"), F.col("g"), F.col("b")))).alias("colors"),
    )


def exact_histogram(px: DataFrame) -> DataFrame:
    """``image_id, rank, rgb, n, first_p``: distinct opaque colours by falling count, ties by first pixel."""
    rgb = color.pack24(F.col("r"), F.col("g"), F.col("b")).alias("rgb")
    counts = opaque(px).groupBy("image_id", rgb).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first_p"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "first_p")))


def coarse_histogram(px: DataFrame) -> DataFrame:
    """``image_id, bin, n`` and sums of RGB and Lab over 15-bit colour bins."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    distinct = opaque(px).groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))  # Lab once for each colour, not pixel
    lab = distinct.select("image_id", color.pack15(r, g, b).alias("bin"), "r", "g", "b", "n", color.rgb_to_lab(r, g, b).alias("lab"))
    w = lambda c: F.sum(F.col(c) * F.col("n"))
    return lab.groupBy("image_id", "bin").agg(
        F.sum("n").alias("n"), *(w(c).alias(f"sum_{c}") for c in "rgb"), *(F.sum(F.col(f"lab.{c}") * F.col("n")).alias(f"sum_lab_{c.lower()}") for c in "Lab")
    )


def bounded_palette(palette: DataFrame) -> DataFrame:
    """The palette, or one row more than it may have: enough to refuse it, never too much to broadcast."""
    return palette.limit(MOST_ENTRIES + 1)


def nearest_entry(colors: DataFrame, palette: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``label``: the palette entry (``idx, r, g, b``; more than 256 rows are refused) nearest in Lab, the first of equals."""
    pal = bounded_palette(palette).select("idx", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("q"))
    here = colors.select(*keys, color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    entries = F.array_sort(F.collect_list(F.struct("idx", "q")))
    refused = F.raise_error(F.lit(f"a palette has at most {MOST_ENTRIES} entries"))
    all_q = pal.agg(F.when(F.count(F.lit(1)) <= MOST_ENTRIES, entries).otherwise(refused).alias("qs"))
    far = lambda e: F.struct(F.round(sum(((F.col("c")[k] - e["q"][k]) * (F.col("c")[k] - e["q"][k]) for k in ("a", "b")), (F.col("c")["L"] - e["q"]["L"]) * (F.col("c")["L"] - e["q"]["L"])), 9).alias("d"), e["idx"].alias("i"))
    return here.crossJoin(F.broadcast(all_q)).select(*keys, F.array_min(F.transform("qs", far))["i"].alias("label"))


def assign_palette(px: DataFrame, palette: DataFrame) -> DataFrame:
    """``image_id, p, label`` of the opaque pixels: the exact entry (the last of equals), else the nearest one, decided for
    each 15-bit key by the first pixel in scan order that is no entry."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    exact = bounded_palette(palette).groupBy(color.pack24(r, g, b).alias("rgb")).agg(F.max("idx").alias("exact"))
    keyed = opaque(px).select("image_id", "p", "r", "g", "b", color.pack24(r, g, b).alias("rgb"), color.pack15(r, g, b).alias("bin")).join(F.broadcast(exact), "rgb", "left")
    first = keyed.where("exact IS NULL").groupBy("image_id", "bin").agg(F.min_by(F.struct("r", "g", "b"), "p").alias("c")).select("image_id", "bin", "c.r", "c.g", "c.b")
    near = nearest_entry(first, palette, "image_id", "bin")
    return keyed.join(near, ["image_id", "bin"], "left").select("image_id", "p", F.coalesce("exact", "label").alias("label"))


def cluster_means(near: DataFrame) -> DataFrame:
    """``cluster, weight, lab, red, green, blue``: weighted means in Lab and in RGB (rounded) of colours ``r, g, b, n, label``."""
    lab = near.withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    whole = [F.floor(mean(c) + 0.5).cast("int").alias(name) for c, name in zip("rgb", ("red", "green", "blue"))]
    return lab.groupBy(F.col("label").alias("cluster")).agg(F.sum("n").alias("weight"), F.struct(*(mean(f"lab.{c}").alias(c) for c in "Lab")).alias("lab"), *whole)
