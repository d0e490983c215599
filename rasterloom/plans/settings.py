"""Settings of many requests as rows: presets under overrides, and what follows from the numbers, as Column expressions.

The same rules as ``plans.options`` and the kernel, for tables of requests; tests hold both against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.text import clamp_int
from rasterloom.plans.options import INTEGERS, PRESETS, Options, as_dict

_TYPES = {"max_colors": "int", "detail": "int", "smoothing": "int", "denoise": "int", "color_merge_threshold": "double", "stroke_mode": "string", "max_dimension": "double"}


def preset_rows(spark: SparkSession) -> DataFrame:
    """``id, label`` and the main settings of the presets, a row each."""
    full = {i: (label, as_dict(Options(**o))) for i, (label, o) in PRESETS.items()}
    kind = {"int": int, "double": float, "string": str}
    rows = [(i, label, *(kind[t](o[k]) for k, t in _TYPES.items())) for i, (label, o) in full.items()]
    return spark.createDataFrame(rows, "id string, label string, " + ", ".join(f"{k} {t}" for k, t in _TYPES.items()))


def resolve_rows(asked: DataFrame, preset: str = "id") -> DataFrame:
    """``asked`` with the settings of its presets; a column ``o_<setting>`` that isn't null goes first, integers are clamped."""
    presets = preset_rows(asked.sparkSession).withColumnRenamed("id", preset)
    full = asked.join(F.broadcast(presets), preset)  # as many rows as there are presets
    for k in _TYPES:
        value = F.coalesce(F.col(f"o_{k}"), F.col(k).cast("double")) if f"o_{k}" in asked.columns else F.col(k)
        full = full.withColumn(k, clamp_int(value.cast("double"), *INTEGERS[k]) if k in INTEGERS else value)
    return full.drop(*(f"o_{k}" for k in _TYPES))


def epsilon(detail: Column) -> Column:
    """Simplification tolerance."""
    return F.when(detail >= 99.5, 0.0).otherwise(0.55 + 2.6 * F.pow((100 - detail) / 100.0, F.lit(1.3)))


def corner_degrees(smoothing: Column) -> Column:
    return 8 + 92 * F.pow(smoothing / 100.0, F.lit(0.9))


def noise_gate(denoise: Column) -> Column:
    return 0.04 + 0.16 * (1 - denoise / 100.0)


def median_radius(denoise: Column) -> Column:
    return F.when(denoise <= 10, 0).when(denoise >= 75, 2).otherwise(1)


def least_area(denoise: Column, width: Column | int, height: Column | int) -> Column:
    size = (F.lit(width) if isinstance(width, int) else width) * height
    return F.greatest(F.lit(2), F.floor(size * 0.00002 * (0.4 + denoise / 100.0 * 1.6) + 0.5)).cast("int")
