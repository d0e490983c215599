"""One image from pixels to colour layers of filled shapes and strokes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from rasterloom.kernel import conditioning, fit, planar, regions, strokes
from rasterloom.kernel.color import distinct_names, hex_of, name_of, rgb_of
from rasterloom.kernel.palette import reduce_colours
from rasterloom.plans.options import Options, least_area, noise_gate


@dataclass
class Contour:
    path: tuple
    area: float  # signed, in traced pixels; negative for holes

    @property
    def is_hole(self) -> bool:
        return self.area < 0


@dataclass
class Shape:
    contours: list[Contour]  # the outline first
    pixels: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return fit.bounds(self.contours[0].path)


@dataclass
class Stroke:
    path: tuple
    closed: bool
    width: float


@dataclass
class Layer:
    color: tuple[int, int, int]
    name: str = ""
    shapes: list[Shape] = field(default_factory=list)
    strokes: list[Stroke] = field(default_factory=list)
    pixels: int = 0

    @property
    def hex(self) -> str:
        return hex_of(self.color)

    @property
    def nodes(self) -> int:
        return sum(len(c.path[1]) for s in self.shapes for c in s.contours) + sum(len(s.path[1]) for s in self.strokes)


@dataclass
class Traced:
    width: int
    height: int
    traced_width: int
    traced_height: int
    layers: list[Layer]
    palette: list[str]
    exact: bool
    stats: dict
    stroke_report: dict
    options: Options


def relist(layers: list[Layer]) -> list[Layer]:
    """Layers by falling area, shapes by falling size, names made distinct."""
    layers = sorted(layers, key=lambda layer: -layer.pixels)
    for layer in layers:
        layer.shapes.sort(key=lambda s: -s.pixels)
    for layer, name in zip(layers, distinct_names([name_of(layer.color) for layer in layers])):
        layer.name = name
    return layers


def count(layers: list[Layer]) -> dict:
    return {
        "colors": len(layers),
        "pieces": sum(len(layer.shapes) for layer in layers),
        "strokes": sum(len(layer.strokes) for layer in layers),
        "nodes": sum(layer.nodes for layer in layers),
    }


def prepare(rgba: np.ndarray, o: Options) -> tuple[np.ndarray, float]:
    """Scaled, hardened and, where it is noisy enough, median-filtered pixels; and the scale."""
    small, scale = conditioning.downscale(rgba, o.max_dimension)
    small = conditioning.harden(small, o.alpha_threshold)
    if o.denoise > 10 and conditioning.noise(small) >= noise_gate(o.denoise):
        small = conditioning.median(small, conditioning.denoise_radius(o.denoise, small.shape[1], small.shape[0]))
    return small, scale


def clean_labels(labels: np.ndarray, o: Options, least: float) -> np.ndarray:
    labels, _ = regions.despeckle(labels, least)
    if o.denoise >= 70:
        labels, _ = regions.despeckle(regions.smooth(labels), least, 2)
    return labels


def _only_emptiness(loops: list[planar.Loop], chains: list[planar.Chain]) -> bool:
    return all((chains[c].right if r else chains[c].left) < 0 for loop in loops for c, r in loop.chains)


def _shapes(outers: list[Contour], holes: list[Contour], pixels: int) -> list[Shape]:
    """Each hole goes to the tightest outline whose bounds hold its start; pixels are shared out by outline area."""
    if len(outers) == 1:
        return [Shape([outers[0], *holes], pixels)]
    boxes, own = [fit.bounds(c.path) for c in outers], [[] for _ in outers]
    for hole in holes:
        x, y = hole.path[0]
        inside = [i for i, b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3]]
        own[min(inside or range(len(outers)), key=lambda i: abs(outers[i].area))].append(hole)
    total = sum(abs(c.area) for c in outers) or 1.0
    return [Shape([c, *h], math.floor(pixels * abs(c.area) / total + 0.5)) for c, h in zip(outers, own)]


def vectorize(rgba: np.ndarray, options: Options = Options()) -> Traced:
    """All stages over an (h, w, 4) array of 8-bit RGBA."""
    o = options.clamped()
    height, width = rgba.shape[:2]
    if not width or not height:
        raise ValueError("the image is empty")
    pixels, scale = prepare(rgba, o)
    h, w = pixels.shape[:2]
    sx, sy = width / w, height / h
    least = max(1, math.floor(least_area(o, width, height) * scale * scale + 0.5))
    reduced = reduce_colours(pixels, o.max_colors, o.color_merge_threshold, o.alpha_threshold, o.seed, [rgb_of(c) for c in o.palette] if o.palette else None)
    labels, removed = reduced.labels, None
    if o.background != "keep":
        removed = regions.backdrop(labels)
        if removed is None and o.background == "remove":
            removed = regions.border_label(labels)
        if removed is not None:
            labels = regions.remove_backdrop(labels, removed)
    labels = clean_labels(labels, o, least)
    found = regions.components(labels)
    ids = np.where(found.label[found.ids] < 0, -1, found.ids)
    chains, loops = planar.trace(ids)
    before = sum(len(c.points) for c in chains)
    fitted = [fit.fit_chain(c.points, c.closed, o.detail, o.smoothing) for c in chains]
    fitted = [f and fit.transform(f, sx, sy) for f in fitted]
    back = [f and fit.reverse(f) for f in fitted]
    by_region: dict[int, list[planar.Loop]] = {}
    for loop in loops:
        if len(loop.vertices) >= 3 and abs(loop.area) >= 0.5:
            by_region.setdefault(loop.region, []).append(loop)

    layers: dict[int, Layer] = {}
    report = {"converted": 0, "blocked": 0, "widths": []}
    dropped = repaired = 0
    bar = strokes.FORCED_ELONGATION if o.stroke_mode == "force" else o.min_stroke_elongation
    for region in np.flatnonzero(found.label >= 0).tolist():
        own, label = by_region.get(region, []), int(found.label[region])
        size = math.floor(int(found.area[region]) * sx * sy + 0.5)
        layer = layers.setdefault(label, Layer(tuple(int(v) for v in reduced.palette[label])))
        if o.stroke_mode != "off" and own:
            x0, y0, x1, y1 = found.box[region]
            mask = np.pad(found.ids[y0 : y1 + 1, x0 : x1 + 1] == region, 1)
            lines = strokes.centreline(mask, int(found.area[region]), bar, o.detail, o.smoothing)
            if lines and not _only_emptiness(own, chains):
                report["blocked"] += 1
                lines = None
            if lines:
                for s in lines:
                    path = fit.transform(s["path"], sx, sy, (float(x0) - 1) * sx, (float(y0) - 1) * sy)
                    layer.strokes.append(Stroke(path, s["closed"], s["width"] * math.sqrt(sx * sy)))
                report["converted"] += 1
                report["widths"].append(lines[0]["width"] * math.sqrt(sx * sy))
                layer.pixels += size
                continue
        contours = []
        for loop in own:
            parts = [(back if r else fitted)[c] for c, r in loop.chains]
            if all(parts):
                contours.append(Contour((parts[0][0], [s for p in parts for s in p[1]]), loop.area))
            else:
                outline = np.array(loop.vertices, float) * (sx, sy)
                contours.append(Contour(fit.polyline(outline, True), loop.area))
        outers, holes = [c for c in contours if not c.is_hole], [c for c in contours if c.is_hole]
        if not outers and holes:
            outers = [max(holes, key=lambda c: abs(c.area))]
            holes = [c for c in holes if c is not outers[0]]
            repaired += 1
        if not outers:
            dropped += 1
            continue
        layer.shapes += _shapes(outers, holes, size)
        layer.pixels += size
    done = relist([layer for layer in layers.values() if layer.shapes or layer.strokes])
    widths = sorted(report["widths"])
    stats = count(done) | {
        "nodes_before_fitting": before,
        "dropped_regions": dropped,
        "repaired_regions": repaired,
        "node_reduction": before / max(1, sum(layer.nodes for layer in done)),
    }
    stroke_report = {
        "converted": report["converted"], "blocked": report["blocked"],
        "median_width": math.floor(widths[len(widths) // 2] * 100 + 0.5) / 100 if widths else None,
    }
    return Traced(width, height, w, h, done, [hex_of(c) for c in reduced.palette], reduced.exact, stats, stroke_report, o)
