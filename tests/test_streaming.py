"""The streaming forms give what the batch forms give."""

import datetime as dt
import os

from rasterloom.streaming.requests import debounce, latest, watch_folder


def events(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, "trace", at(0), 1), (1, "trace", at(100), 2), (1, "edit", at(900), 3), (2, "trace", at(50), 4), (1, "trace", at(60_000), 5)]
    return spark.createDataFrame(rows, "session long, kind string, ts timestamp, request long")


def test_newer_requests_supersede_older_ones(spark):
    got = {(r["session"], r["kind"]): (r["request"], r["superseded"]) for r in latest(events(spark)).collect()}
    assert got == {(1, "trace"): (5, 2), (1, "edit"): (3, 0), (2, "trace"): (4, 0)}


def test_bursts_fire_once(spark, tmp_path):
    batch = sorted((r["session"], r["request"], r["n"]) for r in debounce(events(spark)).collect())
    assert batch == [(1, 2, 2), (1, 3, 1), (1, 5, 1), (2, 4, 1)]
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(9, "trace", dt.datetime(2024, 1, 2), 9)], "session long, kind string, ts timestamp, request long")
    stream = spark.readStream.schema(late.schema).parquet(str(tmp_path / "in"))
    q = debounce(stream, late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    late.withColumn("ts", late.ts + dt.timedelta(days=1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    streamed = sorted((r["session"], r["request"], r["n"]) for r in spark.table("bursts").collect())
    assert [r for r in streamed if r[0] != 9] == batch


def test_new_files_are_handled_once(spark, tmp_path):
    seen = []
    os.makedirs(tmp_path / "in")
    handle = lambda df, n: seen.extend(r["path"] for r in df.collect())
    for name in ("a.png", "b.png"):
        (tmp_path / "in" / name).write_bytes(b"x")
        watch_folder(spark, str(tmp_path / "in"), handle, str(tmp_path / "cp")).awaitTermination()
    assert sorted(os.path.basename(p) for p in seen) == ["a.png", "b.png"]
