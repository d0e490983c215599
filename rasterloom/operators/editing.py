"""Palette edits as relations: suggested merges, plans, recolouring, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color


def suggest_merges(palette: DataFrame, limit: float = 8.0, *keys: str) -> DataFrame:
    """``keep, absorb, delta_e``: pairs of an image's palette (at most 256 entries) nearer than ``limit``; the heavier keeps, on ties the first."""
    lab = palette.select(*keys, "idx", "weight", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    a, b = lab.alias("a"), lab.alias("b")
    cond = F.col("a.idx") < F.col("b.idx")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, cond).select(*(F.col(f"a.{k}") for k in keys), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.weight").alias("wi"), F.col("b.weight").alias("wj"), color.delta_e2000(F.col("a.lab"), F.col("b.lab")).alias("d"))
    keep = F.when(F.col("wi") >= F.col("wj"), F.col("i")).otherwise(F.col("j"))
    return pairs.where(F.col("d") < limit).select(*keys, keep.alias("keep"), F.when(F.col("wi") >= F.col("wj"), F.col("j")).otherwise(F.col("i")).alias("absorb"), F.round("d", 2).alias("delta_e"))


def apply_merges(layers: DataFrame, merges: DataFrame, removals: DataFrame) -> DataFrame:
    """``hex, pixels, pieces, rank``: layers after one step from absorbed to kept, without the removed, by falling area."""
    left = layers.join(removals, "hex", "left_anti").join(merges.select(F.col("absorb").alias("hex"), "keep"), "hex", "left")
    out = left.groupBy(F.coalesce("keep", "hex").alias("hex")).agg(F.sum("pixels").alias("pixels"), F.sum("pieces").alias("pieces"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pixels"), "hex")))


def unknown_colors(plan: DataFrame, layers: DataFrame) -> DataFrame:
    """The colours of ``plan(hex)`` that no layer has, or that are no colours."""
    normal = color.from_hex(F.col("hex"))
    return plan.select("hex", color.to_hex(normal["r"], normal["g"], normal["b"]).alias("known")).join(layers.select(F.col("hex").alias("known")), "known", "left_anti").select("hex").distinct()


def uniquify(names: DataFrame, *keys: str) -> DataFrame:
    """``names(keys, idx, name)`` with ``label``: repeated names numbered in order of idx."""
    same = Window.partitionBy(*keys, "name")
    n, i = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy("idx"))
    return names.withColumn("label", F.when(n > 1, F.concat_ws(" ", "name", i.cast("string"))).otherwise(F.col("name")))


def pending(suggestions: DataFrame, done: DataFrame) -> DataFrame:
    """Suggestions (``keep, absorb``) of which neither colour is in ``done(hex)``, the merged and removed ones."""
    left = suggestions.join(done.select(F.col("hex").alias("absorb")), "absorb", "left_anti")
    return left.join(done.select(F.col("hex").alias("keep")), "keep", "left_anti")


def prune_palette(counts: DataFrame, image: str = "image_id") -> DataFrame:
    """``counts(image_id, idx, cnt)`` of palettes (at most 256 entries each) without unused entries, the rest numbered densely from 0 as ``dense``."""
    place = F.row_number().over(Window.partitionBy(image).orderBy("idx")) - 1
    return counts.where("cnt > 0").withColumn("dense", place.cast("int"))


def layers(regions: DataFrame, palette: DataFrame) -> DataFrame:
    """``image_id, rank, hex, name, pieces, area, area_share``: regions by their label's colour, largest first, repeated names numbered.

    ``palette(idx, r, g, b)`` holds the colours of the labels ``k``. An image has at most 256 layers, which bounds its windows.
    """
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    sums = regions.groupBy("image_id", "k").agg(F.count(F.lit(1)).alias("pieces"), F.sum("area").alias("area"))
    named = sums.join(palette.withColumnRenamed("idx", "k"), "k").withColumn("name", color.color_name(r, g, b))
    own = Window.partitionBy("image_id")
    named = uniquify(named.withColumn("idx", F.row_number().over(own.orderBy(F.desc("area"), "k"))), "image_id")
    share = F.round(F.col("area") / F.sum("area").over(own), 4)
    return named.select("image_id", F.col("idx").alias("rank"), color.to_hex(r, g, b).alias("hex"), F.col("label").alias("name"), "pieces", "area", share.alias("area_share"))
