"""Saved presets as rows: read from JSON, checked and clamped, saved, deleted, described."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.options import BACKGROUNDS, PRESETS, STROKE_MODES

#: Id prefix, most presets kept, limits of the numbers (names as stored).
PREFIX, MOST, LABEL_LENGTH = "custom:", 24, 40
BOUNDS = {
    "maxColors": (1, 256), "detail": (0, 100), "smoothing": (0, 100), "denoise": (0, 100), "colorMergeThreshold": (0, 50),
    "maxDimension": (64, 8192), "precision": (0, 6), "minArea": (1, 1_000_000), "minStrokeElongation": (1, 50),
}
_CHOICES = {"background": BACKGROUNDS, "strokeMode": STROKE_MODES}
#: What ``describe`` tells of the options, in order.
_WORDS = (("maxColors", "{} colors"), ("detail", "detail {}"), ("smoothing", "smoothing {}"), ("denoise", "denoise {}"), ("colorMergeThreshold", "merge {}"), ("background", "background {}"))
OPTIONS = "struct<" + ",".join([f"{k}:double" for k in BOUNDS] + [f"{k}:string" for k in _CHOICES]) + ">"


def load(stored: DataFrame, column: str = "json", *keys: str) -> DataFrame:
    """``keys, position, id, label, options, created_at`` of the presets in JSON arrays, at most 24 of each.

    What isn't an array gives none. Entries without the prefix, a label or any known setting are
    dropped; numbers are clamped, and what isn't a finite number or a known choice is null. Values keep
    their JSON type, so a number in quotes is no number.
    """
    entries = F.expr(f"variant_get(try_parse_json(`{column}`), '$', 'array<variant>')")
    entries = F.when(F.expr(f"schema_of_variant(try_parse_json(`{column}`)) LIKE 'ARRAY%'"), entries)
    rows = stored.select(*keys, F.posexplode(entries).alias("position", "v"))

    def get(path: str, kind: str) -> Column:
        stored_kind = F.expr(f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))")
        right = stored_kind == "STRING" if kind == "string" else stored_kind.isin("BIGINT", "DOUBLE", "FLOAT") | stored_kind.startswith("DECIMAL")
        return F.when(right, F.expr(f"try_variant_get(v, '{path}', '{kind}')"))

    number = lambda k: F.greatest(F.lit(float(BOUNDS[k][0])), F.least(F.lit(float(BOUNDS[k][1])), get(f"$.options.{k}", "double")))
    numbers = [F.when(get(f"$.options.{k}", "double").isNotNull(), number(k)).alias(k) for k in BOUNDS]
    choices = [F.when(get(f"$.options.{k}", "string").isin(*allowed), get(f"$.options.{k}", "string")).alias(k) for k, allowed in _CHOICES.items()]
    full = rows.select(
        *keys, "position", get("$.id", "string").alias("id"), F.substring(F.trim(get("$.label", "string")), 1, LABEL_LENGTH).alias("label"),
        F.struct(*numbers, *choices).alias("options"), get("$.createdAt", "double").cast("bigint").alias("created_at"),
    )
    known = reduce(lambda a, b: a | b, (F.col(f"options.{k}").isNotNull() for k in (*BOUNDS, *_CHOICES)))
    good = full.where(F.col("id").startswith(PREFIX) & (F.length("label") > 0) & known)
    partition = ", ".join(f"`{k}`" for k in keys) or "0"
    ranked = good.selectExpr("*", f"row_number() OVER (PARTITION BY {partition} ORDER BY position) AS kept")
    return ranked.where(F.col("kept") <= MOST).drop("kept")


def unique_label(label: Column, taken: Column) -> Column:
    """The label, or with the first free number from 2 where ``taken`` (an array) or a built-in preset has it, in any case."""
    all_taken = F.transform(F.concat(F.coalesce(taken, F.array().cast("array<string>")), F.array(*(F.lit(p[0]) for p in PRESETS.values()))), F.lower)
    numbered = F.transform(F.sequence(F.lit(2), F.lit(99)), lambda i: F.concat_ws(" ", label, i.cast("string")))
    free = F.filter(F.concat(F.array(label), numbered), lambda c: ~F.array_contains(all_taken, F.lower(c)))
    return F.coalesce(F.get(free, F.lit(0)), F.concat_ws(" ", label, F.lower(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36))))


def save(presets: DataFrame, new: DataFrame) -> DataFrame:
    """``presets`` with the rows of ``new`` before them, newest first, the oldest dropped beyond 24; columns of ``load`` without position."""
    columns = ("id", "label", "options", "created_at")
    taken = presets.orderBy(F.desc("created_at"), "id").limit(MOST).agg(F.collect_list("label").alias("taken"))
    label = F.coalesce(F.nullif(F.substring(F.trim("label"), 1, LABEL_LENGTH), F.lit("")), F.lit("Untitled preset"))
    named = new.crossJoin(F.broadcast(taken)).withColumn("label", unique_label(label, F.col("taken"))).select(*columns)
    return named.unionByName(presets.select(*columns)).orderBy(F.desc("created_at"), "id").limit(MOST)


def delete(presets: DataFrame, ids: DataFrame) -> DataFrame:
    return presets.join(ids, "id", "left_anti")


def describe(options: Column) -> Column:
    """The set options in a line, parts apart by a middle dot."""

    def plain(k: str) -> Column:
        v = options[k]
        return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")) if k in BOUNDS else v

    parts = [F.when(options[k].isNotNull(), F.format_string(words.replace("{}", "%s"), plain(k))) for k, words in _WORDS]
    parts.append(F.when(options["strokeMode"] != "off", F.concat(F.lit("strokes "), options["strokeMode"])))
    return F.concat_ws(" · ", *parts)


def store(presets: DataFrame) -> DataFrame:
    """One row ``json``: the presets as ``load`` reads them, newest first."""
    kept = presets.orderBy(F.desc("created_at"), "id").limit(MOST)
    entry = F.struct("id", "label", "options", F.col("created_at").alias("createdAt"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("created_at").alias("t"), entry.alias("e"))), asc=False)
    return kept.agg(F.to_json(F.transform(ordered, lambda r: r["e"])).alias("json"))  # at most 24 rows
