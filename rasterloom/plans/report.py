"""Text for people: preset lists, batch reports, tool answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.text import format_bytes, truncate_head
from rasterloom.plans.options import BACKGROUNDS, INTEGERS, PRESETS, RANGES, STROKE_MODES, Options, as_dict

#: Most bytes of output that an answer carries inline, and formats that are text.
INLINE, TEXT_FORMATS = 60_000, ("svg", "eps", "dxf")
#: Most lines of files in a report; the rest is only counted.
LINES = 500

#: What a setting is for, by its name.
ADVICE = {
    "max_colors": "Most colours of the result. Art with no more colours than this keeps them exactly; fewer suit cutting and printing.",
    "detail": "How closely outlines follow the pixels. The middle of the range removes their steps, the top keeps each of them, as pixel art needs.",
    "smoothing": "How far an outline may turn before the turn counts as a corner: low for lettering, high for rounded shapes.",
    "denoise": "How hard specks are removed. Noise is measured first, so clean art is left as it is; 0 for pixel art.",
    "alpha_threshold": "Opacity from which a pixel is part of the drawing.",
    "background": "auto removes an even backdrop that meets the frame and leaves enclosed areas of its colour; keep draws it; remove takes the colour along the frame.",
    "color_merge_threshold": "CIEDE2000 distance below which two colours become one: raise it where compression made many shades of one colour.",
    "max_dimension": "Longest side that is traced; larger images are scaled down first.",
    "precision": "Decimals of coordinates.",
    "seed": "Start of the palette search; the same seed gives the same result.",
    "stroke_mode": "Whether thin regions become strokes along their middle, with a width. Only regions with nothing around them can, or gaps would open.",
    "min_stroke_elongation": "How much longer than wide a region has to be to become a stroke.",
    "min_area": "Pixels below which a region is a speck; by default from denoise and the image's size.",
    "palette": "Colours to use instead of those found.",
}


def settings_guide(spark: SparkSession) -> DataFrame:
    """``setting, least, most, choices, standard, advice`` of every setting; ``standard`` is the engine's own value as JSON."""
    choices = {"background": list(BACKGROUNDS), "stroke_mode": list(STROKE_MODES)}
    rows = []
    for name, value in as_dict(Options()).items():
        least, most = RANGES.get(name) or INTEGERS.get(name) or (None, None)
        as_double = lambda x: None if x is None else float(x)
        rows.append((name, as_double(least), as_double(most), choices.get(name), json.dumps(value), ADVICE[name]))
    return spark.createDataFrame(rows, "setting string, least double, most double, choices array<string>, standard string, advice string")


def presets(spark: SparkSession) -> DataFrame:
    """``id, label, options`` (JSON) of the built-in presets."""
    return spark.createDataFrame([(i, label, json.dumps(as_dict(Options(**o)))) for i, (label, o) in PRESETS.items()], "id string, label string, options string")


def layers_report(results: DataFrame) -> DataFrame:
    """``image_id, hex, name, pieces, strokes, stroke_width, area_share, nodes, light_text`` of the layers of traced images."""
    from rasterloom.functions.color import from_hex, luminance

    total = F.aggregate("layers", F.lit(0).cast("bigint"), lambda a, x: a + x["pixel_count"])
    rows = results.select("image_id", total.alias("total"), F.explode("layers").alias("l"))
    widths = F.transform("l.strokes", lambda s: s["width"])
    mean = F.aggregate(widths, F.lit(0.0), lambda a, x: a + x) / F.size(widths)
    rgb = from_hex(F.col("l.hex"))
    return rows.select(
        "image_id", "l.hex", "l.name", F.size("l.shapes").alias("pieces"), F.size("l.strokes").alias("strokes"), F.when(F.size(widths) > 0, F.round(mean, 2)).alias("stroke_width"),
        F.round(F.col("l.pixel_count") / F.col("total"), 4).alias("area_share"), "l.nodes", (luminance(rgb["r"], rgb["g"], rgb["b"]) < 0.35).alias("light_text"),
    )


def totals(results: DataFrame) -> DataFrame:
    """``status, files, output_bytes, elapsed_ms, dropped, repaired`` of a batch; rows without a time count as 0."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), z("output_bytes").alias("output_bytes"), z("elapsed_ms").alias("elapsed_ms"), z("dropped_regions").alias("dropped"), z("repaired_regions").alias("repaired")
    )


def by_reason(results: DataFrame) -> DataFrame:
    """``status, reason, files, output_bytes`` with subtotals by status and the total, where what is summed over is null."""
    return results.rollup("status", "reason").agg(F.count(F.lit(1)).alias("files"), F.sum("output_bytes").alias("output_bytes"))


def existing(tasks: DataFrame, there: DataFrame, reason: str = "the output exists") -> tuple[DataFrame, DataFrame]:
    """``tasks`` whose ``output_path`` is among those of ``there``, as skipped rows, and the others as they are."""
    paths = there.select("output_path").distinct()
    known = tasks.join(paths, "output_path", "left_semi").withColumns({"status": F.lit("skipped"), "reason": F.lit(reason)})
    return known, tasks.join(paths, "output_path", "left_anti")


def batch_summary(results: DataFrame, directory: str = "", wall_ms: float | None = None) -> str:
    """The report of a batch. A batch has at most 500 files, which bounds what comes to the driver."""
    by = {r["status"]: r for r in totals(results).collect()}
    n = lambda s: by[s]["files"] if s in by else 0
    lines = [f"{sum(r['files'] for r in by.values())} image(s) found" + (f" in {directory}" if directory else "") + ".", "", f"  converted: {n('ok')}   skipped: {n('skipped')}   failed: {n('failed')}"]
    name = truncate_head(F.regexp_replace("image_id", "^(file:)?/*" + directory.strip("/").replace(".", r"\.") + "/?", ""), 31)
    rows = results.select("id", name.alias("name"), "status", "reason", "colors", "pieces", "strokes", "nodes", format_bytes(F.coalesce("output_bytes", F.lit(0))).alias("size")).orderBy("id").limit(LINES).collect()
    if "ok" in by:
        spent = by["ok"]["elapsed_ms"] / 1000
        if wall_ms:
            lines.append(f"  {wall_ms / 1000:.2f}s wall clock, {spent:.2f}s of tracing, {spent * 1000 / wall_ms:.1f}x parallel speedup")
        head = f"{'file':31} {'colors':>6} {'pieces':>7} {'strokes':>7} {'nodes':>6} {'out':>9}"
        lines += ["", head, "-" * len(head)]
        lines += [f"{r['name']:31} {r['colors']:>6} {r['pieces']:>7} {r['strokes']:>7} {r['nodes']:>6} {r['size']:>9}" for r in rows if r["status"] == "ok"]
    for status in ("skipped", "failed"):
        if status in by:
            lines += ["", f"{status.capitalize()} ({n(status)}):", *(f"  {r['name']}: {r['reason']}" for r in rows if r["status"] == status)]
    dropped, repaired = (sum(r[k] for r in by.values()) for k in ("dropped", "repaired"))
    if dropped:
        lines += ["", f"Warning: {dropped} region(s) gave no geometry; some artwork is missing."]
    elif repaired:
        lines += ["", f"Note: {repaired} region(s) had their outline repaired; the output is complete."]
    return "\n".join(lines)


def is_inline(format: Column, size: Column, most: int = INLINE) -> Column:
    return format.isin(*TEXT_FORMATS) & (size <= most)


def answers(results: DataFrame, format: str, most: int = INLINE) -> DataFrame:
    """``image_id, answer``: a JSON document for each image, with the output itself where it is short text."""
    body = F.when(is_inline(F.lit(format), F.col("output_bytes"), most), F.decode("output", "UTF-8"))
    kept = [c for c in results.columns if c not in ("output", "layers", "image_id")]
    return results.select("image_id", F.to_json(F.struct(*kept, F.lit(format).alias("format"), body.alias("content"))).alias("answer"))


def notices(analyses: DataFrame) -> DataFrame:
    """``image_id, worst, notices``: the worst level of an image's findings and its first three that aren't mere information."""
    rank = F.transform("findings", lambda f: F.when(f["level"] == "error", 2).when(f["level"] == "warning", 1).otherwise(0))
    worst = F.when(F.array_max(rank) == 2, "error").when(F.array_max(rank) == 1, "warning").otherwise("info")
    return analyses.select("image_id", worst.alias("worst"), F.slice(F.filter("findings", lambda f: f["level"] != "info"), 1, 3).alias("notices"))
