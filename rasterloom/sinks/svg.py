"""SVG: a group for each colour, relative path data without needless letters."""

from __future__ import annotations

from rasterloom.sinks.numbers import half_up, short

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
_ROUND = ' stroke-linecap="round" stroke-linejoin="round"'


def escape(text: str) -> str:
    for a, b in _ESCAPES:
        text = text.replace(a, b)
    return text


def join(tokens: list[str]) -> str:
    """Tokens with a space only between two numbers of which the second has no sign."""
    out, before = [], ""
    for t in tokens:
        if before and not before[-1].isalpha() and not t[0].isalpha() and t[0] != "-":
            out.append(" ")
        out.append(t)
        before = t
    return "".join(out)


def path_data(path: tuple, digits: int, close: bool = True, relative: bool = True, scale: float = 1.0) -> str:
    """Rounded points first, so errors don't add up over relative steps; lines of no length are left out."""
    at = lambda p: (half_up(p[0] * scale, digits), half_up(p[1] * scale, digits))
    n = lambda v: short(v, digits)
    start, segments = path
    x, y = at(start)
    tokens, last, drawn = ["M", n(x), n(y)], "M", 0

    def command(letter: str, *values: float) -> None:
        nonlocal last
        if letter != last:
            tokens.append(letter)
        tokens.extend(map(n, values))
        last = letter

    for s in segments:
        tx, ty = at(s[-1])
        ox, oy = (x, y) if relative else (0.0, 0.0)
        case = str.lower if relative else str.upper
        if len(s) == 3:
            (ax, ay), (bx, by) = at(s[0]), at(s[1])
            command(case("c"), ax - ox, ay - oy, bx - ox, by - oy, tx - ox, ty - oy)
        elif (tx, ty) == (x, y):
            continue
        elif ty == y:
            command(case("h"), tx - ox)
        elif tx == x:
            command(case("v"), ty - oy)
        else:
            command(case("l"), tx - ox, ty - oy)
        x, y, drawn = tx, ty, drawn + 1
    if not drawn:
        return ""
    return join(tokens + (["Z"] if close else []))


def stroke_groups(layer, digits: int = 2) -> list[tuple[float, list]]:
    """Strokes by their width to two decimals, in order of first use."""
    widths: dict[float, list] = {}
    for s in layer.strokes:
        widths.setdefault(half_up(s.width, digits), []).append(s)
    return list(widths.items())


def _many(n: int, word: str) -> str:
    return f"{n} {word}" + "s" * (n != 1)


def write(
    traced, precision: int | None = None, relative: bool = True, metadata: bool = True, group: bool = True, pretty: bool = True,
    dimensions: bool = True, background: str | None = None, scale: float = 1.0, path_per_shape: bool = False, round_strokes: bool = True,
) -> str:
    digits = traced.options.precision if precision is None else precision
    tab = "  " if pretty else ""
    style = _ROUND if round_strokes else ""
    w, h = short(traced.width, 3), short(traced.height, 3)
    size = f' width="{short(traced.width * scale, 3)}" height="{short(traced.height * scale, 3)}"' if dimensions else ""
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg"{size} viewBox="0 0 {w} {h}">']
    if metadata:
        s = traced.stats
        parts = [_many(s["colors"], "color layer"), _many(s["pieces"], "piece")] + [_many(s["strokes"], "centreline")] * (s["strokes"] > 0)
        lines += [f"{tab}<title>Vectorized artwork</title>", f"{tab}<desc>{', '.join(parts)}, {s['nodes']} nodes.</desc>"]
    if background:
        lines.append(f'{tab}<rect width="{w}" height="{h}" fill="{escape(background)}"/>')
    for number, layer in enumerate(traced.layers, 1):
        each = [[c.path for c in s.contours] for s in layer.shapes]
        fills = ["".join(path_data(p, digits, True, relative) for p in ps) for ps in (each if path_per_shape else [sum(each, [])])]
        fills = [d for d in fills if d]
        strokes = [(width, [path_data(s.path, digits, s.closed, relative) for s in of]) for width, of in stroke_groups(layer)]
        if not fills and not strokes:
            continue
        if not group:
            lines += [f'{tab}<path fill="{layer.hex}" d="{d}"/>' for d in fills]
            lines += [f'{tab}<path fill="none" stroke="{layer.hex}" stroke-width="{short(width, digits)}"{style} d="{d}"/>' for width, ds in strokes for d in ds]
            continue
        count = f' data-strokes="{len(layer.strokes)}"' if layer.strokes else ""
        lines.append(f'{tab}<g id="layer-{number}" data-color="{layer.hex}" data-name="{escape(layer.name)}" data-pieces="{len(layer.shapes)}"{count} fill="{layer.hex}">')
        lines += [f'{tab * 2}<path d="{d}"/>' for d in fills]
        for width, ds in strokes:
            lines.append(f'{tab * 2}<g fill="none" stroke="{layer.hex}" stroke-width="{short(width, digits)}"{style}>')
            lines += [f'{tab * 3}<path d="{d}"/>' for d in ds]
            lines.append(f"{tab * 2}</g>")
        lines.append(f"{tab}</g>")
    lines.append("</svg>")
    return ("\n" if pretty else "").join(lines) + ("\n" if pretty else "")


__all__ = ["escape", "join", "path_data", "stroke_groups", "write"]
