"""Containment of polylines."""

import random
import re

from rasterloom.operators.geometry import enclosing


def test_holes_find_their_outlines_without_sorting_joined_rows(spark):
    rng = random.Random(7)
    holes = [(i % 2, i, float(rng.randint(0, 4)), float(rng.randint(0, 4))) for i in range(200)] + [(0, 900, 2.5, 2.5), (1, 901, None, 1.0)]
    outlines = []
    for i in range(1000, 1150):
        x, y = rng.randint(0, 4), rng.randint(0, 4)
        outlines.append((i % 2, i, float(rng.randint(1, 6)) * rng.choice((1, -1)), float(x), float(y), float(x + rng.randint(0, 3)), float(y + rng.randint(0, 3))))
    df = enclosing(spark.createDataFrame(holes, "group_id long, hole_id long, hx double, hy double"), spark.createDataFrame(outlines, "group_id long, outline_id long, area double, min_x double, min_y double, max_x double, max_y double"))
    want = {}
    for g, h, x, y in holes:
        fits = [(abs(a), o) for k, o, a, x0, y0, x1, y1 in outlines if x is not None and k == g and x0 <= x <= x1 and y0 <= y <= y1]
        if fits:
            want[g, h] = min(fits)[1]
    assert {(r["group_id"], r["hole_id"]): r["outline_id"] for r in df.collect()} == want and len(want) > 150
    # All pairs of a group would be sorted, and spilled, for an aggregate that needs order.
    assert not re.search(r"SortAggregate\(key=\[[^]]*(?:hole_id|hx)", df._jdf.queryExecution().executedPlan().toString())
