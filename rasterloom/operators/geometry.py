"""Polylines and nested paths as relations: wrap-around windows, areas, lengths, bounds, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(points: DataFrame, *keys: str) -> DataFrame:
    """``points(keys, i, x, y)`` with the previous and next vertex of the closed polyline: ``px, py, nx, ny, n``."""
    order = Window.partitionBy(*keys).orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrap = lambda f, g, c: F.coalesce(f(c).over(order), g(c).over(whole))
    return points.select(
        "*", wrap(F.lag, F.last, "x").alias("px"), wrap(F.lag, F.last, "y").alias("py"), wrap(F.lead, F.first, "x").alias("nx"), wrap(F.lead, F.first, "y").alias("ny"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )


def remove_collinear(points: DataFrame, *keys: str, tol: float = 1e-9) -> DataFrame:
    """Vertices at which the closed polyline turns; all of them if fewer than three would stay."""
    cross = (F.col("x") - F.col("px")) * (F.col("ny") - F.col("y")) - (F.col("y") - F.col("py")) * (F.col("nx") - F.col("x"))
    marked = around(points, *keys).withColumn("turns", F.abs(cross) > tol)
    kept = F.count_if(F.col("turns")).over(Window.partitionBy(*keys))
    return marked.withColumn("kept", kept).where("turns OR kept < 3").select(*keys, "i", "x", "y")


def collapse_runs(points: DataFrame, *keys: str) -> DataFrame:
    """Ends of straight runs of an open polyline: first, last, and where the step changes."""
    order = Window.partitionBy(*keys).orderBy("i")
    step = lambda c: F.lead(c).over(order) - F.col(c)
    stepped = points.select("*", step("x").alias("dx"), step("y").alias("dy"))
    before = F.lag(F.struct("dx", "dy")).over(order)
    return stepped.withColumn("before", before).where("before IS NULL OR dx IS NULL OR dx <> before.dx OR dy <> before.dy").select(*keys, "i", "x", "y")


def measures(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, signed_area, perimeter, open_length, min_x, min_y, max_x, max_y`` of each polyline."""
    a = around(points, *keys)
    step = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    last = F.col("i") == F.max("i").over(Window.partitionBy(*keys))
    a = a.withColumn("last", last)
    return a.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("signed_area"),
        F.sum(step).alias("perimeter"), F.coalesce(F.sum(F.when(~F.col("last"), step)), F.lit(0.0)).alias("open_length"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
    )


def chord_parameters(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, u, u_monotone``: arc length so far over the whole, evenly spread where there is none; and its running maximum."""
    order = Window.partitionBy(*keys).orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    s = points.select("*", step.alias("step")).select("*", F.sum("step").over(so_far).alias("run"), F.sum("step").over(Window.partitionBy(*keys)).alias("total"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    u = F.when(F.col("total") > 0, F.col("run") / F.col("total")).when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    return s.withColumn("u", u).select(*keys, "i", "u", F.max("u").over(so_far).alias("u_monotone"))


def farthest_anchors(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, a, b``: the vertex farthest from the centroid and the one farthest from that, the first of equals."""
    far = lambda c, x, y: F.max(F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d"), (-F.col("i")).alias("m"), "x", "y")).alias(c)
    centre = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    a = points.join(centre, list(keys)).groupBy(*keys).agg(far("a", F.round("cx", 9), F.round("cy", 9)))
    b = points.join(a, list(keys)).groupBy(*keys).agg(far("b", F.col("a.x"), F.col("a.y")), F.first("a").alias("a"))
    return b.select(*keys, (-F.col("a.m")).alias("a"), (-F.col("b.m")).alias("b"))


def enclosing(holes: DataFrame, outlines: DataFrame) -> DataFrame:
    """``hole_id, outline_id``: of the outlines whose bounds hold the hole's start, the one of least area (then least id).

    Both have ``group_id``; a group is one region, so the join stays within it. Equal starts and equal
    bounds meet once, and outlines are numbered by area before: joined rows are folded into numbers as
    they arise and never sorted or written.
    """
    least = outlines.groupBy("group_id", "min_x", "min_y", "max_x", "max_y").agg(F.min(F.struct(F.abs("area").alias("size"), "outline_id")).alias("o"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("o"))).withColumn("outline_id", F.col("o.outline_id")).drop("o")
    starts = holes.select("group_id", "hx", "hy").distinct()
    inside = starts.join(ranked, "group_id").where("hx BETWEEN min_x AND max_x AND hy BETWEEN min_y AND max_y")
    best = inside.groupBy("group_id", "hx", "hy").agg(F.min("rank").alias("rank"), F.min_by("outline_id", "rank").alias("outline_id"))
    return holes.join(best, ["group_id", "hx", "hy"]).groupBy("group_id", "hole_id").agg(F.min_by("outline_id", "rank").alias("outline_id"))
