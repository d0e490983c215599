"""Exact invariants of tracing synthetic rasters."""

import numpy as np
import pytest

from rasterloom.kernel import fit, planar, regions
from rasterloom.kernel.tracer import vectorize
from rasterloom.plans.options import PRESETS, Options, clamp_int, resolve
from tests.drawing import blank, disc, photo, rect

RED, BLUE, WHITE, BLACK = (230, 57, 70), (10, 20, 200), (255, 255, 255), (0, 0, 0)


def sizes(t):
    return [(layer.hex, len(layer.shapes), len(layer.strokes), layer.nodes) for layer in t.layers]


def test_square_keeps_its_corners_and_colour():
    t = vectorize(rect(blank(200, 200), 40, 40, 120, 120, RED), Options(max_colors=4))
    assert sizes(t) == [("#e63946", 1, 0, 4)]
    start, segments = t.layers[0].shapes[0].contours[0].path
    assert {start, *(s[-1] for s in segments)} == {(40, 40), (160, 40), (160, 160), (40, 160)} and all(len(s) == 1 for s in segments)


def test_disc_is_a_few_cubics_within_tolerance():
    t = vectorize(disc(blank(300, 300), 150, 150, 110, BLUE), Options(max_colors=3))
    path = t.layers[0].shapes[0].contours[0].path
    assert 4 <= t.stats["nodes"] <= 16 and t.stats["node_reduction"] > 10 and any(len(s) == 3 for s in path[1])
    off = [abs(np.hypot(x - 150, y - 150) - 110) for x, y in fit.flatten(path)]
    assert max(off) < 3


def test_ring_has_an_outline_and_a_hole():
    t = vectorize(disc(disc(blank(300, 300), 150, 150, 120, BLUE), 150, 150, 60, (0, 0, 0, 0)), Options(max_colors=3))
    contours = t.layers[0].shapes[0].contours
    assert [c.is_hole for c in contours] == [False, True] and contours[0].area > 0 > contours[1].area


def test_neighbours_share_their_boundary():
    t = vectorize(rect(blank(200, 120, (*BLACK, 255)), 100, 0, 100, 120, RED), Options(max_colors=4, background="keep"))
    assert t.stats["nodes"] == 8 and t.stats["pieces"] == 2
    for layer in t.layers:
        start, segments = layer.shapes[0].contours[0].path
        assert {(100, 0), (100, 120)} <= {start, *(s[-1] for s in segments)}


def test_three_colours_meet_in_one_point():
    a = rect(rect(blank(200, 120, (*BLACK, 255)), 100, 0, 100, 60, RED), 100, 60, 100, 60, (20, 200, 40))
    t = vectorize(a, Options(background="keep"))
    assert len(t.layers) == 3
    for layer in t.layers:
        start, segments = layer.shapes[0].contours[0].path
        assert (100, 60) in {start, *(s[-1] for s in segments)}


def test_checkerboard_is_traced_literally():
    a = blank(80, 80, (*WHITE, 255))
    for i in range(8):
        for j in range(8):
            if (i + j) % 2:
                rect(a, 10 * i, 10 * j, 10, 10, BLACK)
    t = vectorize(a, Options(max_colors=2, background="keep", denoise=0, detail=100, smoothing=0))
    assert (t.stats["pieces"], t.stats["nodes"]) == (64, 256)


def test_backdrop_goes_and_what_it_encloses_stays():
    a = disc(blank(240, 240, (*WHITE, 255)), 120, 120, 90, (200, 0, 0))
    assert len(vectorize(a).layers) == 1 and len(vectorize(a, Options(background="keep")).layers) == 2
    t = vectorize(disc(a, 120, 120, 40, WHITE))
    assert sorted((layer.hex, len(layer.shapes)) for layer in t.layers) == [("#c80000", 1), ("#ffffff", 1)]


def test_downscaled_work_is_scaled_back():
    t = vectorize(rect(blank(3000, 1500), 500, 300, 2000, 900, BLUE), Options(max_dimension=600))
    assert (t.traced_width, t.width, t.height) == (600, 3000, 1500)
    assert abs(t.layers[0].shapes[0].bounds[2] - 2500) <= 12


@pytest.mark.parametrize("mode", ["off", "auto"])
def test_nested_rings_lose_nothing(mode):
    a = blank(320, 320, (*WHITE, 255))
    for r, c in ((150, (200, 0, 0)), (110, (0, 200, 0)), (70, (0, 0, 200)), (30, (250, 250, 0))):
        disc(a, 160, 160, r, c)
    t = vectorize(a, Options(background="keep", stroke_mode=mode))
    assert t.stats["dropped_regions"] == t.stats["repaired_regions"] == 0 and len(t.layers) == 5


def test_arithmetic_noise_is_traced_alike_twice():
    y, x = np.mgrid[:200, :200]
    a = np.dstack([7 * x % 256, 11 * y % 256, x * y % 256, np.full((200, 200), 255)]).astype(np.uint8)
    one, two = (vectorize(a, Options(max_colors=6)) for _ in range(2))
    assert sizes(one) == sizes(two) and len(one.layers) <= 6 and one.stats["dropped_regions"] == 0


def test_edge_cases():
    assert vectorize(blank(1, 1, (255, 0, 0, 255)), Options(max_colors=2, background="keep")).stats["nodes"] == 4
    assert vectorize(blank(50, 50)).layers == []
    assert vectorize(rect(blank(100, 100), 10, 50, 80, 1, BLACK)).stats["pieces"] == 1
    with pytest.raises(ValueError):
        vectorize(np.zeros((0, 5, 4), np.uint8))


def test_near_equal_colours_merge_at_a_threshold():
    a = blank(200, 200, (230, 57, 70, 255))
    a[:, 100:] = (232, 59, 72, 255)
    apart, merged = (vectorize(a, Options(color_merge_threshold=m, background="keep")) for m in (0, 8))
    assert len(apart.layers) == 2 and len(merged.layers) == 1 and merged.stats["nodes"] < apart.stats["nodes"]


@pytest.mark.parametrize("preset", PRESETS)
def test_every_preset_runs(preset):
    t = vectorize(disc(rect(blank(200, 200, (*WHITE, 255)), 20, 20, 60, 60, RED), 140, 140, 40, BLUE), resolve(preset))
    assert {"#e63946", "#0a14c8"} <= {layer.hex for layer in t.layers} and t.stats["dropped_regions"] == 0


# --- strokes


def auto(a, **k):
    return vectorize(a, Options(stroke_mode="auto", **k))


def test_bar_becomes_a_stroke():
    t = auto(rect(blank(240, 120), 20, 56, 200, 9, BLACK))
    (s,) = t.layers[0].strokes
    assert abs(s.width - 9) <= 0.5 and len(s.path[1]) == 1 and abs(s.path[0][1] - 60.5) <= 0.5 and not t.layers[0].shapes


def test_cross_has_four_arms_that_meet():
    t = auto(rect(rect(blank(200, 200), 20, 96, 160, 8, BLACK), 96, 20, 8, 160, BLACK))
    strokes = t.layers[0].strokes
    assert len(strokes) == 4
    for s in strokes:
        ends = [s.path[0], s.path[1][-1][-1]]
        assert min(np.hypot(x - 100, y - 100) for x, y in ends) <= 6


def test_ring_is_one_closed_stroke():
    t = auto(disc(disc(blank(260, 260), 130, 130, 94, BLACK), 130, 130, 86, (0, 0, 0, 0)))
    (s,) = t.layers[0].strokes
    assert s.closed and abs(s.width - 8) <= 0.5
    assert all(abs(np.hypot(x - 130, y - 130) - 90) <= 3 for x, y in fit.flatten(s.path))


def test_strokes_need_emptiness_around_them():
    a = rect(blank(240, 120, (*WHITE, 255)), 20, 56, 200, 9, BLACK)
    kept, removed = auto(a, background="keep"), auto(a, background="remove")
    assert kept.stats["strokes"] == 0 and kept.stroke_report["blocked"] >= 1 and removed.stats["strokes"] == 1


def test_chunky_bars_need_force():
    a = rect(blank(160, 160), 30, 60, 90, 30, BLACK)
    assert auto(a).stats["strokes"] == 0 and vectorize(a, Options(stroke_mode="force")).stats["strokes"] == 1


def test_stroke_report_of_a_mixture():
    a = rect(rect(rect(blank(240, 240), 20, 20, 200, 8, BLACK), 20, 60, 200, 8, BLACK), 40, 120, 120, 60, BLACK)
    t = auto(a)
    assert t.stroke_report["converted"] == 2 and t.stats["pieces"] == 1 and abs(t.stroke_report["median_width"] - 8) <= 0.5


# --- parts


def test_loop_areas_add_up_to_region_areas():
    rng = np.random.default_rng(3)
    for _ in range(5):
        labels = rng.integers(0, 3, (40, 30))
        found = regions.components(labels)
        _, loops = planar.trace(found.ids)
        total = np.zeros(len(found.area))
        for loop in loops:
            total[loop.region] += loop.area
        assert np.allclose(total, found.area)
        for r in range(len(found.area)):
            assert sum(not x.is_hole for x in loops if x.region == r) == 1


def test_components_agree_with_flood_fill():
    rng = np.random.default_rng(4)
    labels = rng.integers(-1, 2, (25, 25))
    ids, n = np.full(labels.shape, -1), 0
    for y in range(25):
        for x in range(25):
            if ids[y, x] < 0:
                todo = [(y, x)]
                ids[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 25 and 0 <= d < 25 and ids[c, d] < 0 and labels[c, d] == labels[a, b]:
                            ids[c, d] = n
                            todo.append((c, d))
                n += 1
    assert (regions.components(labels).ids == ids).all()


def test_specks_take_the_label_they_border_longest_and_holes_fill():
    labels = np.zeros((9, 9), int)
    labels[:, 5:] = 1
    labels[4, 4] = 2  # three sides of 0, one of 1
    labels[2, 7] = -1  # a transparent hole is a speck like any other
    out, gone = regions.despeckle(labels, 3)
    assert gone == 2 and out[4, 4] == 0 and out[2, 7] == 1


def test_distance_field_is_exact_and_the_border_is_no_background():
    from rasterloom.kernel.strokes import distance_squared

    rng = np.random.default_rng(5)
    mask = rng.random((14, 17)) > 0.2
    off = np.argwhere(~mask)
    want = [[min((y - a) ** 2 + (x - b) ** 2 for a, b in off) for x in range(17)] for y in range(14)]
    assert (distance_squared(mask) == np.array(want)).all()


def test_paths_reverse_and_flatten():
    path = ((0.0, 0.0), [((1.0, 2.0), (3.0, 2.0), (4.0, 0.0)), ((9.0, 0.0),)])
    assert fit.reverse(fit.reverse(path)) == path
    assert fit.flatten(path)[0] == (0.0, 0.0) and fit.flatten(path)[-1] == (9.0, 0.0)
    assert abs(fit.curve_length(((0.0, 0.0), [((3.0, 4.0),)])) - 5) < 1e-9


def test_options():
    assert clamp_int(float("nan"), 1, 9) == 1 and clamp_int(4.5, 1, 9) == 5 and clamp_int(99, 1, 9) == 9
    o = resolve("logo", {"detail": 10}, {"detail": 90, "denoise": 70})
    assert (o.detail, o.denoise, o.smoothing) == (10, 70, 45)
    with pytest.raises(ValueError):
        resolve("nothing")


def test_photographs_are_refused():
    from rasterloom.kernel.analysis import analyze

    a = analyze(photo())
    assert a["suitability"] == "poor" and a["classification"] == "photo" and a["findings"][0][0] == "error"
    clean = analyze(disc(blank(300, 300), 150, 150, 110, BLUE))
    assert clean["noise_estimate"] == 0 and clean["suitability"] == "excellent"
    assert any("Low" in m or "Only 40" in m for _, m in analyze(disc(blank(40, 40, (255, 255, 255, 255)), 20, 20, 12, BLUE))["findings"])


def test_noise_against_the_plain_definition():
    from rasterloom.kernel.conditioning import noise

    rng = np.random.default_rng(7)
    for spread in (3, 30, 255):
        a = rng.integers(0, spread + 1, (20, 24, 4)).astype(np.uint8)
        a[..., 3] = np.where(rng.random((20, 24)) < 0.03, 0, 255)
        dev = samples = over = seen = 0
        luma = lambda p: 299 * int(p[0]) + 587 * int(p[1]) + 114 * int(p[2])
        for y in range(1, 19):
            for x in range(1, 23):
                cells = a[y - 1 : y + 2, x - 1 : x + 2].reshape(9, 4)
                if (cells[:, 3] < 250).any():
                    continue
                seen += 1
                ring = [luma(c) for i, c in enumerate(cells) if i != 4]
                over += luma(cells[4]) > max(ring) + 4000 or luma(cells[4]) < min(ring) - 4000
                if int(cells[:, :3].max()) - int(cells[:, :3].min()) <= 24:
                    for c in range(3):
                        row = [int(v) for v in a[y, x - 1 : x + 2, c]]
                        dev += abs(row[1] - sorted(row)[1])
                        samples += 1
        want = min(1, max((dev / samples / 12 if samples else 0) / 0.02, over / seen / 0.006))
        assert abs(noise(a) - want) < 1e-12
