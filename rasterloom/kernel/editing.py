"""Palette edits of a traced image: suggested merges, merging, removal."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from rasterloom.kernel.color import ciede2000, hex_of, lab, rgb_of
from rasterloom.kernel.tracer import Layer, Traced, count, relist, vectorize


def normal(text: str) -> str:
    """A colour as #rrggbb; what isn't one, trimmed and in lower case."""
    try:
        return hex_of(rgb_of(text))
    except ValueError:
        return text.strip().lower()


def suggest_merges(traced: Traced, limit: float = 8.0) -> list[dict]:
    """Pairs of layers nearer than ``limit``; the larger (on a tie the first) absorbs the other."""
    layers = traced.layers
    if len(layers) < 2:
        return []
    total = sum(layer.pixels for layer in layers) or 1
    i, j = np.triu_indices(len(layers), 1)
    points = lab(np.array([layer.color for layer in layers]))
    out = []
    for a, b, d in zip(i.tolist(), j.tolist(), ciede2000(points[i], points[j]).tolist()):
        if d < limit:
            keep, absorb = (a, b) if layers[a].pixels >= layers[b].pixels else (b, a)
            out.append({"keep": layers[keep].hex, "absorb": layers[absorb].hex, "delta_e": round(d, 2), "area_share": round(layers[absorb].pixels / total, 4)})
    return sorted(out, key=lambda s: s["delta_e"])


def plan(suggestions: list[dict]) -> list[tuple[str, list[str]]]:
    """Groups (keep, absorbed) that follow chains of suggestions."""
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for s in suggestions:
        a, b = find(s["keep"]), find(s["absorb"])
        if a != b:
            parent[b] = a
    groups: dict[str, list[str]] = {}
    for c in list(parent):
        if find(c) != c:
            groups.setdefault(find(c), []).append(c)
    return list(groups.items())


def check_colors(traced: Traced, colors: list[str]) -> None:
    known = {layer.hex for layer in traced.layers}
    unknown = [c for c in colors if normal(c) not in known]
    if unknown:
        raise ValueError(f"not in the palette: {', '.join(unknown)}; it has {', '.join(sorted(known))}")


def _with(traced: Traced, layers: list[Layer]) -> Traced:
    layers = relist(layers)
    stats = traced.stats | count(layers)
    stats["node_reduction"] = stats["nodes_before_fitting"] / max(1, stats["nodes"])
    return replace(traced, layers=layers, stats=stats)


def merge_fast(traced: Traced, groups: list[tuple[str, list[str]]], remove: list[str] = ()) -> Traced:
    """Recolour and join layers as they are (one step from absorbed to kept); geometry and nodes don't change."""
    to = {normal(a): normal(k) for k, absorbed in groups for a in absorbed}
    gone = {normal(r) for r in remove}
    out: dict[str, Layer] = {}
    for layer in traced.layers:
        if layer.hex in gone:
            continue
        target = to.get(layer.hex, layer.hex)
        into = out.setdefault(target, Layer(rgb_of(target)))
        into.shapes, into.strokes, into.pixels = into.shapes + layer.shapes, into.strokes + layer.strokes, into.pixels + layer.pixels
    return _with(traced, list(out.values()))


def remove_layers(traced: Traced, colors: list[str]) -> Traced:
    gone = {normal(c) for c in colors}
    return _with(traced, [layer for layer in traced.layers if layer.hex not in gone])


def merge_exact(rgba: np.ndarray, traced: Traced, groups: list[tuple[str, list[str]]], remove: list[str] = ()) -> Traced:
    """Trace again with the palette that is left after merging, then remove.

    A colour that the first trace took away as the backdrop is put back into the palette, so its
    pixels are not drawn in another colour but found and removed again.
    """
    absorbed = {normal(a) for _, of in groups for a in of}
    shown = [layer.hex for layer in traced.layers]
    backdrop = [c for c in traced.palette if c not in shown] if traced.options.background != "keep" else []
    left = [c for c in shown if c not in absorbed]
    if not left:
        return traced
    again = vectorize(rgba, replace(traced.options, palette=tuple(left + [c for c in backdrop if c not in absorbed])))
    return remove_layers(again, list(remove)) if remove else again
