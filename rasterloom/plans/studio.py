"""What users call: analyze, vectorize, compare presets, suggest and apply colour edits, convert folders.

An image is one row with its compact pixels, so nothing is shuffled and no image is gathered from
pixels; failures are rows with a reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.plans.options import PRESETS, check, resolve
from rasterloom.plans.report import existing
from rasterloom.scratch import Scratch
from rasterloom.session import ship_package
from rasterloom.sources.images import MOST_FILES, discover, open_images, output_paths, rgba, wanted_files

_SETTINGS = "struct<max_colors:int,denoise:int,color_merge_threshold:double>"
ANALYSIS = (
    "image_id string, status string, reason string, width int, height int, has_alpha boolean, transparent_ratio double, unique_colors int, "
    "unique_colors_capped boolean, flat_ratio double, soft_edge_ratio double, hard_edge_ratio double, noise_estimate double, classification string, "
    "suitability string, score int, findings array<struct<level:string,message:string>>, recommended_preset string, "
    f"recommended {_SETTINGS}, rationale string"
)
_POINT = "struct<x:double,y:double>"
_SEGMENT = f"struct<kind:string,c1:{_POINT},c2:{_POINT},to:{_POINT}>"
_CONTOUR = f"struct<start:{_POINT},segments:array<{_SEGMENT}>,signed_area:double,is_hole:boolean>"
_STROKE = f"struct<start:{_POINT},segments:array<{_SEGMENT}>,closed:boolean,width:double>"
LAYER = (
    f"struct<index:int,hex:string,name:string,pixel_count:bigint,nodes:int,shapes:array<struct<pixel_count:bigint,contours:array<{_CONTOUR}>>>,strokes:array<{_STROKE}>>"
)
RESULT = (
    "image_id string, status string, reason string, preset string, width int, height int, traced_width int, traced_height int, exact boolean, palette array<string>, "
    "colors int, pieces int, strokes int, nodes int, nodes_before_fitting int, dropped_regions int, repaired_regions int, node_reduction double, "
    "strokes_converted int, strokes_blocked int, median_stroke_width double, score int, classification string, suitability string, "
    f"layers array<{LAYER}>, output binary, output_bytes bigint, elapsed_ms double"
)


def _points(path: tuple) -> tuple[dict, list[dict]]:
    p = lambda q: {"x": q[0], "y": q[1]}
    return p(path[0]), [
        {"kind": "cubic", "c1": p(s[0]), "c2": p(s[1]), "to": p(s[2])} if len(s) == 3 else {"kind": "line", "c1": None, "c2": None, "to": p(s[0])} for s in path[1]
    ]


def layer_rows(traced) -> list[dict]:
    out = []
    for i, layer in enumerate(traced.layers):
        shapes = []
        for s in layer.shapes:
            contours = []
            for c in s.contours:
                start, segments = _points(c.path)
                contours.append({"start": start, "segments": segments, "signed_area": c.area, "is_hole": c.is_hole})
            shapes.append({"pixel_count": s.pixels, "contours": contours})
        strokes = []
        for s in layer.strokes:
            start, segments = _points(s.path)
            strokes.append({"start": start, "segments": segments, "closed": s.closed, "width": s.width})
        out.append({"index": i, "hex": layer.hex, "name": layer.name, "pixel_count": layer.pixels, "nodes": layer.nodes, "shapes": shapes, "strokes": strokes})
    return out


#: Fixed value: seconds after which an image fails.
MOST_SECONDS = 120


@contextmanager
def time_limit(seconds: float) -> Iterator:
    """Raises TimeoutError within the block after so many seconds. Only a process's main thread can be stopped so; others run on."""
    import signal
    import threading

    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError(f"took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _per_image(images: DataFrame, one: Callable, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """``one(pixels, row)`` gives the rows of an image as dicts; what it raises becomes a row with status ``failed``.

    The columns ``keep`` of the image are passed on with each of its rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(images.sparkSession)
    names = ["image_id", "width", "height", "channels", "data", "reason", *keep]
    spark_schema = StructType([*images.select(*keep).schema.fields, *StructType.fromDDL(schema).fields])

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = to_arrow_schema(spark_schema)
        for b in batches:
            for i in range(b.num_rows):  # one image at a time becomes Python objects
                (row,) = b.slice(i, 1).to_pylist()
                begun = time.perf_counter()
                try:
                    if row["data"] is None:
                        raise ValueError(row["reason"] or "there is no image")
                    with time_limit(MOST_SECONDS):
                        got = one(rgba(row["data"], row["width"], row["height"], row["channels"]), row)
                except Exception as e:  # one bad image fails alone
                    got = [{"status": "failed", "reason": str(e) or type(e).__name__}]
                taken = (time.perf_counter() - begun) * 1000
                given = {"image_id": row["image_id"], "elapsed_ms": taken} | {k: row[k] for k in keep}
                full = [{n: None for n in arrow.names} | given | g for g in got]
                yield pa.RecordBatch.from_pylist([{n: g[n] for n in arrow.names} for g in full], schema=arrow)

    return images.select(*names).mapInArrow(rows, spark_schema)


def _analysis(pixels, row: dict) -> list[dict]:
    from rasterloom.kernel.analysis import analyze as measure

    a = measure(pixels)
    found = [{"level": level, "message": message} for level, message in a["findings"]]
    settings = {k: a["recommended"].get(k) for k in ("max_colors", "denoise", "color_merge_threshold")}
    return [a | {"status": "ok", "findings": found, "recommended": settings}]


def analyze(images: DataFrame) -> DataFrame:
    """Verdict, findings and recommended settings of every image."""
    return _per_image(images, _analysis, ANALYSIS)


def _traced_row(traced, a: dict, preset: str, layers: bool, format: str | None, output: dict) -> dict:
    from rasterloom.sinks import render

    body = render(traced, format, **output) if format else None
    return {k: v for k, v in traced.stats.items()} | {
        "status": "ok", "preset": preset, "width": traced.width, "height": traced.height, "traced_width": traced.traced_width, "traced_height": traced.traced_height,
        "exact": traced.exact, "palette": traced.palette, "strokes_converted": traced.stroke_report["converted"], "strokes_blocked": traced.stroke_report["blocked"],
        "median_stroke_width": traced.stroke_report["median_width"], "score": a["score"], "classification": a["classification"], "suitability": a["suitability"],
        "layers": layer_rows(traced) if layers else None, "output": body, "output_bytes": len(body) if body is not None else None,
    }


def trace_with(pixels, preset: str, overrides: dict):
    """(traced, analysis, preset used): ``auto`` takes the recommended preset and settings, a named preset only its own."""
    from rasterloom.kernel.analysis import analyze as measure
    from rasterloom.kernel.tracer import vectorize as trace

    a = measure(pixels)
    used = a["recommended_preset"] if preset == "auto" else preset
    return trace(pixels, resolve(used, overrides, a["recommended"] if preset == "auto" else None)), a, used


def vectorize(images: DataFrame, preset: str = "auto", overrides: dict | None = None, format: str | None = "svg", layers: bool = True, min_score: int = 0, output: dict | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Trace every image. Images that score under ``min_score`` are skipped before the trace, with a reason; columns ``keep`` are passed on."""
    given = dict(overrides or {})
    check(given)  # wrong settings fail here, not on the executors
    resolve("logo" if preset == "auto" else preset, given).clamped()

    def one(pixels, row: dict) -> list[dict]:
        if min_score > 0:
            a = _analysis(pixels, row)[0]
            if a["score"] < min_score:
                seen = {k: a[k] for k in ("score", "classification", "suitability", "width", "height")}
                return [seen | {"status": "skipped", "reason": f"score {a['score']} is under {min_score}"}]
        traced, a, used = trace_with(pixels, preset, given)
        return [_traced_row(traced, a, used, layers, format, output or {})]

    return _per_image(images, one, RESULT, keep)


def compare_presets(images: DataFrame, presets: Sequence[str] = tuple(PRESETS)) -> DataFrame:
    """A row for each image and preset: colours, pieces, nodes, bytes, milliseconds."""

    def one(pixels, row: dict) -> list[dict]:
        out = []
        for preset in presets:
            begun = time.perf_counter()
            traced, a, used = trace_with(pixels, preset, {})
            out.append(_traced_row(traced, a, used, False, "svg", {}) | {"output": None, "elapsed_ms": (time.perf_counter() - begun) * 1000})
        return out

    return _per_image(images, one, RESULT).select("image_id", "status", "reason", "preset", "colors", "pieces", "strokes", "nodes", "output_bytes", "elapsed_ms")


def suggest_merges(images: DataFrame, preset: str = "auto", overrides: dict | None = None, threshold: float = 8.0) -> DataFrame:
    """Pairs of layers nearer than ``threshold`` and how many colours would be left."""
    schema = "image_id string, status string, reason string, keep string, absorb string, delta_e double, area_share double, colors int, projected_colors int"

    def one(pixels, row: dict) -> list[dict]:
        from rasterloom.kernel.editing import suggest_merges as suggest

        traced, _, _ = trace_with(pixels, preset, dict(overrides or {}))
        found = suggest(traced, threshold)
        left = len(traced.layers) - len({s["absorb"] for s in found})
        return [s | {"status": "ok", "colors": len(traced.layers), "projected_colors": left} for s in found]

    return _per_image(images, one, schema)


def refine(
    images: DataFrame, merge: Sequence[tuple[str, Sequence[str]]] = (), remove: Sequence[str] = (), auto_merge_below: float | None = None,
    preset: str = "auto", overrides: dict | None = None, format: str | None = "svg",
) -> DataFrame:
    """Merge (by tracing again with what is left of the palette) and remove colours; unknown ones fail the image."""

    def one(pixels, row: dict) -> list[dict]:
        from rasterloom.kernel import editing

        traced, a, used = trace_with(pixels, preset, dict(overrides or {}))
        groups = [(k, list(v)) for k, v in merge]
        editing.check_colors(traced, [c for k, v in groups for c in (k, *v)] + list(remove))
        if auto_merge_below is not None:
            named = {editing.normal(c) for k, v in groups for c in (k, *v)}
            groups += [(k, v) for k, v in editing.plan(editing.suggest_merges(traced, auto_merge_below)) if k not in named and not named & set(v)]
        edited = editing.merge_exact(pixels, traced, groups, list(remove)) if groups else editing.remove_layers(traced, list(remove))
        return [_traced_row(edited, a, used, True, format, {})]

    return _per_image(images, one, RESULT)


def vectorize_batch(
    spark: SparkSession, directory: str | None = None, output: str | None = None, paths: Sequence[str] | None = None, preset: str = "auto",
    overrides: dict | None = None, format: str = "svg", recursive: bool = False, limit: int = 500, min_score: int = 35, overwrite: bool = False, dry_run: bool = False,
) -> DataFrame:
    """Convert a folder: a row for each file with status ``ok``, ``skipped`` or ``failed``.

    Outputs that exist already are skipped by an anti-join before anything is decoded, and only planned
    files are read. A dry run traces but doesn't write. Outputs mirror the input tree and are written
    by the executors. The rows come by id; ``left_out`` counts the files beyond the limit.
    """
    from rasterloom.sinks import extension

    files = discover(spark, directory, paths, recursive=recursive, limit=limit)
    root = (directory or "").rstrip("/")
    tasks = files.select("id", F.col("path").alias("image_id"), output_paths(F.col("path"), root, output or root, extension(format)).alias("output_path"))
    skipped = None
    if not overwrite and output:
        try:
            there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(output).select(F.regexp_replace("path", r"^file:/+", "/").alias("output_path"))
            skipped, tasks = existing(tasks, there)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scratch = Scratch(spark, "batch")
    tasks = scratch.save(tasks)
    # A batch has at most 500 tasks, so their paths may come to the driver and the tasks can be broadcast; no other file is decoded.
    planned = [r["image_id"] for r in tasks.select("image_id").collect()]
    if planned:
        same = F.regexp_replace("image_id", r"^file:/+", "/")
        todo = open_images(spark, planned).withColumn("key", same).join(F.broadcast(tasks.select(same.alias("key"), "id", "output_path")), "key")
        done = vectorize(todo, preset, overrides, format, layers=False, min_score=min_score, keep=("id", "output_path"))
        result = done.drop("layers", "traced_width", "traced_height", "palette")
        result = (result if dry_run else write_outputs(result)).drop("output")
        # Written once, so that neither reading it twice nor counting traces or writes again.
        result = scratch.save(result)
        result = result if skipped is None else result.unionByName(skipped, allowMissingColumns=True)
    else:
        empty = spark.createDataFrame([], StructType.fromDDL(f"id int, output_path string, {RESULT}")).drop("layers", "traced_width", "traced_height", "palette", "output")
        result = empty if skipped is None else empty.unionByName(skipped, allowMissingColumns=True)
    return result.orderBy("id")


def left_out(spark: SparkSession, directory: str | None = None, paths: Sequence[str] | None = None, recursive: bool = False, limit: int = 500) -> int:
    """How many image files a batch with this limit does not take."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory if directory is not None else list(paths))
    n = wanted_files(files.select("path"), directory).count()
    return max(0, n - min(limit, MOST_FILES))


def write_outputs(rows: DataFrame) -> DataFrame:
    """Write ``output`` to ``output_path`` of every row that has both, and pass the rows on; a failed write is a failed row.

    Paths are those of a file system that all executors mount.
    """
    names = rows.columns

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pyarrow as pa

        for b in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            got = b.to_pylist()
            for r in got:
                if r["output"] is not None and r["output_path"]:
                    try:
                        os.makedirs(os.path.dirname(r["output_path"]), exist_ok=True)
                        # Under another name first: what has the final name is whole, whenever a task is lost.
                        part = f"{r['output_path']}.{uuid.uuid4().hex}.part"
                        with open(part, "wb") as f:
                            f.write(r["output"])
                        os.replace(part, r["output_path"])
                    except OSError as e:
                        r["status"], r["reason"] = "failed", str(e)
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in got], schema=b.schema)

    return rows.mapInArrow(write, rows.schema)
