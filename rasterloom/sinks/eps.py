"""Encapsulated PostScript, with short names for the operators."""

from __future__ import annotations

import math

from rasterloom.kernel.color import rgb_of
from rasterloom.sinks.numbers import fixed, half_up
from rasterloom.sinks.pdf import operators, unit

#: The prolog's names.
NAMES = {"m": "moveto", "l": "lineto", "c": "curveto", "h": "closepath", "f": "fill", "s": "stroke", "k": "setrgbcolor"}


def comment(text: str) -> str:
    return " ".join(text.splitlines())[:200]


def write(traced, dpi: float = 96, precision: int = 3, background: str | None = None, title: str = "Vectorized artwork") -> str:
    scale = 72 / dpi
    w, h = traced.width * scale, traced.height * scale
    lines = [
        "%!PS-Adobe-3.0 EPSF-3.0", f"%%BoundingBox: 0 0 {math.ceil(w)} {math.ceil(h)}", f"%%HiResBoundingBox: 0 0 {fixed(w, 4)} {fixed(h, 4)}",
        f"%%Title: {comment(title)}", "%%LanguageLevel: 2", "%%EndComments", "%%BeginProlog",
        *(f"/{a} {{{b}}} bind def" for a, b in NAMES.items()), "%%EndProlog", "%%Page: 1 1", "gsave",
        f"[{fixed(scale, 6)} 0 0 {fixed(-scale, 6)} 0 {fixed(h, 6)}] concat",
    ]
    if background:
        x, y = fixed(traced.width, precision), fixed(traced.height, precision)
        lines += [f"{unit(rgb_of(background))} k", f"newpath 0 0 m {x} 0 l {x} {y} l 0 {y} l h f"]
    for number, layer in enumerate(traced.layers, 1):
        lines += [f"%% layer {number}: {comment(layer.name)} {layer.hex}", f"{unit(layer.color)} k"]
        if layer.shapes:
            lines += ["newpath", *(operators(c.path, precision, True) for s in layer.shapes for c in s.contours), "f"]
        width = None
        if layer.strokes:
            lines.append("1 setlinecap 1 setlinejoin")
        for s in layer.strokes:
            if half_up(s.width, 3) != width:
                width = half_up(s.width, 3)
                lines.append(f"{fixed(width, precision)} setlinewidth")
            lines += ["newpath", operators(s.path, precision, s.closed), "s"]
    return "\n".join([*lines, "grestore", "showpage", "%%EOF", ""])
