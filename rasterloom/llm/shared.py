"""What several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.scratch import Scratch, shared_root

__all__ = ["Scratch", "only", "shared_root", "unit_hash"]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def unit_hash(*parts: Column | str) -> Column:
    """A double in [0, 1) that md5 of the joined parts gives; SQL engines agree on it."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
