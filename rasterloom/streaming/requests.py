"""Interactive requests as events: superseding, debouncing; and folders as a stream.

The batch forms and the streaming forms give the same rows for the same events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(requests: DataFrame) -> DataFrame:
    """``session, kind, request, superseded``: the newest request of a session and kind answers, all older ones are rejected."""
    newest = F.max_by("request", F.struct("ts", "request"))
    return requests.groupBy("session", "kind").agg(newest.alias("request"), (F.count(F.lit(1)) - 1).alias("superseded"))


def debounce(requests: DataFrame, gap: str = "180 milliseconds", late: str | None = None) -> DataFrame:
    """``session, fired_from, request, n``: the last request of each burst, a burst being events less than ``gap`` apart.

    On a stream, ``late`` is the watermark after which a burst is final.
    """
    events = requests.withWatermark("ts", late) if late else requests
    burst = F.session_window("ts", gap)
    out = events.groupBy("session", burst).agg(F.max_by("request", F.struct("ts", "request")).alias("request"), F.count(F.lit(1)).alias("n"))
    return out.select("session", F.col("session_window.start").alias("fired_from"), "request", "n")


def watch_folder(spark, directory: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.png"):
    """A streaming query that hands each micro-batch of new files (``path, modificationTime, length, content``) to ``handle``.

    The source's own log makes it exactly-once per file; ``handle`` should skip outputs that exist,
    since a batch can be repeated after a failure.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(directory)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
