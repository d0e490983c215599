"""DXF R12: flattened polylines on a layer for each colour, strokes on layers named by their width."""

from __future__ import annotations

from rasterloom.kernel.fit import flatten
from rasterloom.sinks.numbers import fixed

#: Colour index and RGB of the entries that are matched.
ACI = (
    (1, (255, 0, 0)), (2, (255, 255, 0)), (3, (0, 255, 0)), (4, (0, 255, 255)), (5, (0, 0, 255)), (6, (255, 0, 255)),
    (7, (255, 255, 255)), (8, (128, 128, 128)), (9, (192, 192, 192)), (250, (51, 51, 51)), (251, (91, 91, 91)), (252, (132, 132, 132)),
    (30, (255, 127, 0)), (140, (0, 127, 255)), (190, (127, 0, 255)), (90, (0, 255, 127)),
)


def nearest_index(color) -> int:
    return min(ACI, key=lambda e: sum((int(a) - b) ** 2 for a, b in zip(color, e[1])))[0]


def layer_name(number: int, hex_: str, width: float | None = None) -> str:
    return f"RL_{number:02d}_{hex_.lstrip('#')}" + (f"_W{width:.2f}".replace(".", "p") if width is not None else "")


def write(traced, tolerance: float = 0.1, units_per_pixel: float = 1.0, precision: int = 4) -> str:
    out: list[str] = []
    put = lambda *pairs: out.extend(str(v) for p in pairs for v in p)
    n = lambda v: fixed(v * units_per_pixel, precision)
    origin = ((10, 0), (20, 0), (30, 0))
    names: dict[str, int] = {"0": 7}
    lines = []
    for number, layer in enumerate(traced.layers, 1):
        aci, name = nearest_index(layer.color), layer_name(number, layer.hex)
        names[name] = aci
        lines += [(name, aci, flatten(c.path, tolerance), True, 3) for s in layer.shapes for c in s.contours]
        for s in layer.strokes:
            names[layer_name(number, layer.hex, s.width)] = aci
            lines.append((layer_name(number, layer.hex, s.width), aci, flatten(s.path, tolerance), s.closed, 2))
    put((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (9, "$INSBASE"), *origin, (9, "$EXTMIN"), *origin)
    put((9, "$EXTMAX"), (10, n(traced.width)), (20, n(traced.height)), (30, 0), (0, "ENDSEC"))
    put((0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (70, len(names)))
    for name, aci in names.items():
        put((0, "LAYER"), (2, name), (70, 0), (62, aci), (6, "CONTINUOUS"))
    put((0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    for name, aci, points, closed, least in lines:
        if len(points) < least:
            continue
        put((0, "POLYLINE"), (8, name), (62, aci), (66, 1), (70, int(closed)), *origin)
        for x, y in points:
            put((0, "VERTEX"), (8, name), (10, n(x)), (20, n(traced.height - y)), (30, 0))
        put((0, "SEQEND"), (8, name))
    put((0, "ENDSEC"), (0, "EOF"))
    return "\n".join(out) + "\n"
