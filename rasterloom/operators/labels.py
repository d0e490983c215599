"""Label maps as relations: runs, regions, borders, specks, smoothing, backdrop, cracks.

Rows are ``image_id, p, x, y, k`` with ``p`` the scan position. Neighbours along a row or column come
from windows over that row or column, whose size the image's side bounds; square neighbourhoods are
scattered (each pixel is sent to the centres that see it) and aggregated, which takes one shuffle
and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rasterloom.scratch import Scratch
from rasterloom.session import ship_package


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")



def runs(px: DataFrame) -> DataFrame:
    """``image_id, y, x0, x1, k, p0``: maximal runs of a label within a row (gaps and islands)."""
    flagged = px.withColumn("start", (~F.lag("k").over(along_row()).eqNullSafe(F.col("k"))).cast("int"))
    numbered = flagged.withColumn("run", F.sum("start").over(along_row().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("k").alias("k"), F.min("p").alias("p0")).drop("run")


def run_roots(px: DataFrame) -> DataFrame:
    """``image_id, y, x0, x1, k, root``: each run with the scan position of its region's first pixel.

    Runs, not pixels, go to one function call per image, which joins those that touch by union-find.
    """
    ship_package(px.sparkSession)

    def unite(table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("y", "x0", "x1", "k", "p0"))))
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        start = {}
        for i, r in enumerate(rows):
            start.setdefault(r[0], [i, i])[1] = i
        for y, (a, a1) in start.items():
            if y + 1 not in start:
                continue
            b, b1 = start[y + 1]
            while a <= a1 and b <= b1:
                if rows[a][3] == rows[b][3] and rows[a][1] <= rows[b][2] and rows[b][1] <= rows[a][2]:
                    m, n = find(a), find(b)
                    parent[max(m, n)] = min(m, n)
                if rows[a][2] < rows[b][2]:
                    a += 1
                else:
                    b += 1
        image = table.column("image_id").to_pylist()
        roots = [rows[find(i)][4] for i in range(len(rows))]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table({"image_id": image, "y": pa.array(cols[0], pa.int32()), "x0": pa.array(cols[1], pa.int32()), "x1": pa.array(cols[2], pa.int32()), "k": pa.array(cols[3], pa.int32()), "root": pa.array(roots, pa.int64())})

    return runs(px).groupBy("image_id").applyInArrow(unite, "image_id string, y int, x0 int, x1 int, k int, root bigint")


def run_roots_distributed(px: DataFrame, most: int = 60) -> DataFrame:
    """As ``run_roots``, for an image too large for one task: least roots over touching runs, with pointer jumping.

    Each round is written to the shared folder and read again, which cuts lineage, survives lost
    executors, and keeps size estimates true (those of checkpoints are squared by every join).
    """
    scratch = Scratch(px.sparkSession, "roots")
    r = scratch.save(runs(px))
    a = r.select("image_id", F.col("y"), "k", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("p0").alias("a"))
    b = r.select("image_id", (F.col("y") - 1).alias("y"), "k", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("p0").alias("b"))
    touch = a.join(b, ["image_id", "y", "k"]).where("a0 <= b1 AND b0 <= a1").select("image_id", "a", "b")
    touch = scratch.save(touch.unionByName(touch.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = scratch.save(r.select("image_id", F.col("p0").alias("a"), F.col("p0").alias("root")))
    for _ in range(most):
        near = touch.join(roots.withColumnRenamed("a", "b"), ["image_id", "b"]).groupBy("image_id", "a").agg(F.min("root").alias("seen"))
        hooked = scratch.save(roots.join(near, ["image_id", "a"], "left").select("image_id", "a", F.col("root").alias("was"), F.least("root", "seen").alias("to")))
        jump = hooked.select("image_id", F.col("a").alias("to"), F.col("to").alias("next"))
        moved = hooked.join(jump, ["image_id", "to"]).select("image_id", "a", F.least("to", "next").alias("root"), (F.least("to", "next") != F.col("was")).alias("changed"))
        moved = scratch.save(moved)
        scratch.drop(roots)
        scratch.drop(hooked)
        roots = moved
        if roots.where("changed").limit(1).count() == 0:
            return r.join(roots.select("image_id", F.col("a").alias("p0"), "root"), ["image_id", "p0"]).select("image_id", "y", "x0", "x1", "k", "root")
    raise RuntimeError(f"regions did not settle in {most} rounds")


def regions(rooted: DataFrame) -> DataFrame:
    """``image_id, region_id, root, k, area, min_x, min_y, max_x, max_y``, numbered by first pixel."""
    r = rooted.groupBy("image_id", "root").agg(
        F.first("k").alias("k"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y")
    )
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1
    return r.select("image_id", number.alias("region_id"), "root", "k", "area", "min_x", "min_y", "max_x", "max_y")


def with_roots(rooted: DataFrame) -> DataFrame:
    """``image_id, x, y, k, root``: runs back to pixels."""
    return rooted.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "k", "root")


def sides(px: DataFrame, *columns: str) -> DataFrame:
    """A row for each pixel and existing 4-neighbour: ``side`` (0 left, 1 right, 2 up, 3 down), the neighbour's columns with ``n_``."""
    both = px.select("*", F.struct(*columns).alias("me"))
    around = F.array(*(f("me").over(w) for w in (along_row(), along_column()) for f in (F.lag, F.lead)))
    both = both.select(*px.columns, around.alias("around"))
    out = both.select(*px.columns, F.posexplode("around").alias("side", "n")).where("n IS NOT NULL")
    return out.select(*px.columns, "side", *(F.col(f"n.{c}").alias(f"n_{c}") for c in columns))


def despeckle_once(px: DataFrame, rooted: DataFrame, least: int) -> DataFrame:
    """``image_id, x, y, k``: regions under ``least`` pixels take the neighbour label they border longest, first seen on ties."""
    areas = rooted.groupBy("image_id", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    at = with_roots(rooted).join(px.select("image_id", "x", "y", "p"), ["image_id", "x", "y"])
    border = sides(at, "root", "k").where("n_root <> root").groupBy("image_id", "root", "n_k").agg(F.count(F.lit(1)).alias("len"), F.min(F.col("p") * 4 + F.col("side")).alias("seen"))
    winner = border.groupBy("image_id", "root").agg(F.max_by("n_k", F.struct("len", -F.col("seen"))).alias("to"))
    change = winner.join(areas.where(F.col("area") < least), ["image_id", "root"]).select("image_id", "root", "to")
    return with_roots(rooted).join(change, ["image_id", "root"], "left").select("image_id", "x", "y", F.coalesce("to", "k").alias("k"))


def scatter(px: DataFrame, radius: int, keep: list[str], width: int | Column, height: int | Column, centre: bool = True) -> DataFrame:
    """Each pixel sent to every centre within ``radius`` that lies in the image: ``image_id, x, y, dx, dy`` of the centre and ``keep``."""
    offsets = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if centre or dx or dy)))
    out = px.select("image_id", "x", "y", *keep, offsets.alias("o")).select("image_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "o.dx", "o.dy", *keep)
    return out.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))


def smooth_once(px: DataFrame, width: int, height: int, least: int = 6) -> DataFrame:
    """``image_id, x, y, k``: a label that ``least`` of the 8 neighbours share replaces the pixel's own."""
    seen = scatter(px, 1, ["k"], width, height)
    own = F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("k")))
    ring = F.sum(F.when((F.col("dx") != 0) | (F.col("dy") != 0), 1).otherwise(0))
    counts = seen.groupBy("image_id", "x", "y", "k").agg(ring.alias("n"), own.alias("own"))
    best = counts.groupBy("image_id", "x", "y").agg(F.max(F.struct("n", "k")).alias("m"), F.max("own").alias("own"))
    return best.select("image_id", "x", "y", F.when(F.col("m.n") >= least, F.col("m.k")).otherwise(F.col("own")).alias("k"))


def border_counts(px: DataFrame, width: int, height: int, corners_twice: bool = False) -> DataFrame:
    """``image_id, k, n``: pixels of each label along the border, -1 included."""
    on = lambda c, last: (F.col(c) == 0).cast("int") + (F.col(c) == last - 1).cast("int")
    times = on("x", width) + on("y", height)
    times = times if corners_twice else (times > 0).cast("int")
    return px.withColumn("times", times).where("times > 0").groupBy("image_id", "k").agg(F.sum("times").alias("n"))


def backdrop(px: DataFrame, rooted: DataFrame, width: int, height: int, least_border: float = 0.7, least_whole: float = 0.6) -> DataFrame:
    """``image_id, k, border_share, whole_share, is_backdrop`` of the commonest border label of each image."""
    counts = border_counts(px, width, height)
    best = counts.groupBy("image_id").agg(F.sum("n").alias("all_n"), F.max(F.when(F.col("k") >= 0, F.struct("n", (-F.col("k")).alias("minus")))).alias("m"))
    best = best.where("m IS NOT NULL").select("image_id", (-F.col("m.minus")).alias("k"), (F.col("m.n") / F.col("all_n")).alias("border_share"))
    areas = rooted.groupBy("image_id", "k", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    whole = areas.groupBy("image_id", "k").agg((F.max("area") / F.sum("area")).alias("whole_share"))
    return best.join(whole, ["image_id", "k"]).withColumn("is_backdrop", (F.col("border_share") >= least_border) & (F.col("whole_share") >= least_whole))


def remove_backdrop(rooted: DataFrame, found: DataFrame, width: int, height: int) -> DataFrame:
    """The runs, with those regions of the backdrop label made -1 that touch the border."""
    edge = rooted.where((F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1))
    gone = edge.join(found.where("is_backdrop").select("image_id", "k"), ["image_id", "k"], "left_semi").select("image_id", "root").distinct().withColumn("gone", F.lit(True))
    return rooted.join(gone, ["image_id", "root"], "left").select("image_id", "y", "x0", "x1", F.when(F.col("gone"), -1).otherwise(F.col("k")).alias("k"), "root")


def cracks(px: DataFrame, width: int, height: int, label: str = "k") -> DataFrame:
    """``image_id, x, y, kind, a, b``: lattice edges whose two cells differ (-1 outside): h from (x, y) east, v from (x, y) south."""
    c = F.col(label)
    left, up = F.coalesce(F.lag(label).over(along_row()), F.lit(-1)), F.coalesce(F.lag(label).over(along_column()), F.lit(-1))
    edge = lambda kind, x, y, a, b: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    x, y, none = F.col("x"), F.col("y"), F.lit(-1)
    found = F.array(
        edge("v", x, y, left, c), edge("h", x, y, up, c),
        F.when(x == width - 1, edge("v", x + 1, y, c, none)), F.when(y == height - 1, edge("h", x, y + 1, c, none)),
    )
    around = px.select("image_id", found.alias("found"))
    real = F.filter("found", lambda e: e.isNotNull() & (e["a"] != e["b"]))
    return around.select("image_id", F.explode(real).alias("e")).select("image_id", "e.x", "e.y", "e.kind", "e.a", "e.b")


def vertices(edges: DataFrame) -> DataFrame:
    """``image_id, x, y, degree, is_node``: lattice points on a boundary; junctions have more than two edges."""
    ends = F.array(
        F.struct("x", "y"),
        F.when(F.col("kind") == "h", F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y"))).otherwise(F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y"))),
    )
    return edges.select("image_id", F.explode(ends).alias("v")).groupBy("image_id", "v.x", "v.y").agg(F.count(F.lit(1)).alias("degree")).withColumn("is_node", F.col("degree") > 2)
