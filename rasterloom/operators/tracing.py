"""Boundary graph, fitted paths, distance fields and skeletons as relations: one function call per image.

Input is a label map ``image_id, p, x, y, k``. What walks in order inside one image runs in the numpy
kernel; what comes out are rows again, for joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import ship_package

_POINTS = "array<struct<x:double,y:double>>"
CHAINS = f"image_id string, chain_id int, points {_POINTS}, closed boolean, region_right int, region_left int"
LOOPS = f"image_id string, loop_id int, region_id int, k int, chains array<struct<chain:int,reversed:boolean>>, vertices {_POINTS}, signed_area double, is_hole boolean"
PATHS = f"image_id string, chain_id int, start struct<x:double,y:double>, segments array<struct<c1:struct<x:double,y:double>,c2:struct<x:double,y:double>,to:struct<x:double,y:double>>>, n_segments int"
FIELD = "image_id string, x int, y int, distance_squared double"
BRANCHES = f"image_id string, branch_id int, points {_POINTS}, closed boolean, free_ends int, length double"


def _by_image(px: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """``rows_of(labels)`` gives rows as dicts for the (h, w) array of an image's labels (-1 where there is no row)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(px.sparkSession)
    spark_schema = StructType.fromDDL(schema)

    def run(table):
        import numpy as np
        import pyarrow as pa

        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        labels = np.full((int(y.max()) + 1, int(x.max()) + 1), -1, np.int64)
        labels[y, x] = table.column("k").to_numpy()
        image = table.column("image_id")[0].as_py()
        return pa.Table.from_pylist([{"image_id": image} | r for r in rows_of(labels)], schema=to_arrow_schema(spark_schema))

    return px.select("image_id", "x", "y", "k").groupBy("image_id").applyInArrow(run, spark_schema)


def _points(p) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def _graph(labels):
    import numpy as np

    from rasterloom.kernel import planar, regions

    found = regions.components(labels)
    ids = np.where(found.label[found.ids] < 0, -1, found.ids)
    return found, *planar.trace(ids)


def chains(px: DataFrame) -> DataFrame:
    """Boundary chains between junctions, each once for both of its sides."""

    def rows(labels):
        _, found, _ = _graph(labels)
        return [{"chain_id": i, "points": _points(c.points), "closed": c.closed, "region_right": c.right, "region_left": c.left} for i, c in enumerate(found)]

    return _by_image(px, rows, CHAINS)


def loops(px: DataFrame) -> DataFrame:
    """Closed loops of each region: references to chains, lattice corners, and the area, negative for holes."""

    def rows(labels):
        regions, _, found = _graph(labels)
        return [
            {
                "loop_id": i, "region_id": r.region, "k": int(regions.label[r.region]), "chains": [{"chain": c, "reversed": b} for c, b in r.chains],
                "vertices": _points(r.vertices), "signed_area": r.area, "is_hole": r.is_hole,
            }
            for i, r in enumerate(found)
        ]

    return _by_image(px, rows, LOOPS)


def fit_chains(chained: DataFrame, detail: int = 55, smoothing: int = 60) -> DataFrame:
    """Fitted paths of chains, one by one: any partitioning will do, and both sides of a boundary get one path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(chained.sparkSession)
    spark_schema = StructType.fromDDL(PATHS)

    def fit(batches):
        import pyarrow as pa

        from rasterloom.kernel.fit import fit_chain

        schema = to_arrow_schema(spark_schema)
        point = lambda p: {"x": p[0], "y": p[1]}
        for b in batches:
            out = []
            for r in b.to_pylist():
                path = fit_chain([(p["x"], p["y"]) for p in r["points"]], r["closed"], detail, smoothing)
                if path:
                    segments = [{"c1": point(s[0]) if len(s) == 3 else None, "c2": point(s[1]) if len(s) == 3 else None, "to": point(s[-1])} for s in path[1]]
                    out.append({"image_id": r["image_id"], "chain_id": r["chain_id"], "start": point(path[0]), "segments": segments, "n_segments": len(segments)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return chained.select("image_id", "chain_id", "points", "closed").mapInArrow(fit, PATHS)


def loop_nodes(looped: DataFrame, paths: DataFrame) -> DataFrame:
    """``image_id, region_id, loops, nodes``: segments of each region's outlines, by joining loops to the fitted chains they share."""
    refs = looped.select("image_id", "loop_id", "region_id", F.explode("chains.chain").alias("chain_id"))
    joined = refs.join(paths.select("image_id", "chain_id", "n_segments"), ["image_id", "chain_id"])
    return joined.groupBy("image_id", "region_id").agg(F.count_distinct("loop_id").alias("loops"), F.sum("n_segments").alias("nodes"))


def distance_field(px: DataFrame, label: int) -> DataFrame:
    """Squared distance of each pixel of a label to the nearest pixel of another; the border is no other pixel."""

    def rows(labels):
        import numpy as np

        from rasterloom.kernel.strokes import distance_squared

        mask = labels == label
        field = distance_squared(mask) if mask.any() and not mask.all() else np.zeros(labels.shape)
        return [{"x": int(x), "y": int(y), "distance_squared": float(field[y, x])} for y, x in np.argwhere(mask)]

    return _by_image(px, rows, FIELD)


def skeleton(px: DataFrame, label: int) -> DataFrame:
    """Branches of the thinned shape of a label."""

    def rows(labels):
        from rasterloom.kernel.strokes import branches, skeleton

        found = branches(skeleton(labels == label))
        return [{"branch_id": i, "points": _points(b["points"]), "closed": b["closed"], "free_ends": b["free"], "length": b["length"]} for i, b in enumerate(found)]

    return _by_image(px, rows, BRANCHES)
