"""PDF 1.4 with one page and exact cross-reference offsets."""

from __future__ import annotations

from itertools import accumulate

from rasterloom.kernel.color import rgb_of
from rasterloom.sinks.numbers import fixed, half_up


def operators(path: tuple, digits: int, close: bool) -> str:
    n = lambda *v: " ".join(fixed(x, digits) for x in v)
    out = [f"{n(*path[0])} m"]
    out += [f"{n(*s[0], *s[1], *s[2])} c" if len(s) == 3 else f"{n(*s[0])} l" for s in path[1]]
    return "\n".join(out + ["h"] * close)


def unit(color) -> str:
    return " ".join(fixed(v / 255, 4) for v in color)


def escape(text: str) -> str:
    for c in "\\()":
        text = text.replace(c, "\\" + c)
    return text


def content(traced, scale: float, digits: int, background: str | None) -> str:
    """Drawing operators: the page is flipped once, so paths keep their coordinates."""
    lines = ["q", f"{fixed(scale, 6)} 0 0 {fixed(-scale, 6)} 0 {fixed(traced.height * scale, 6)} cm"]
    if background:
        lines += [f"{unit(rgb_of(background))} rg", f"0 0 {fixed(traced.width, digits)} {fixed(traced.height, digits)} re f"]
    for layer in traced.layers:
        if layer.shapes:
            lines.append(f"{unit(layer.color)} rg")
            lines += [operators(c.path, digits, True) for s in layer.shapes for c in s.contours]
            lines.append("f")
        if layer.strokes:
            lines += [f"{unit(layer.color)} RG", "1 J 1 j"]
            width = None
            for s in layer.strokes:
                if half_up(s.width, 3) != width:
                    width = half_up(s.width, 3)
                    lines.append(f"{fixed(width, digits)} w")
                lines += [operators(s.path, digits, s.closed), "S"]
    return "\n".join(lines + ["Q"])


def object_offsets(objects, document: str, order: str, length: str, head: int = 0):
    """``objects`` (a DataFrame) with ``start``: where each object of a document begins, by the lengths of those before it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.lit(head).cast("bigint"))


def write(traced, dpi: float = 96, precision: int = 3, background: str | None = None, title: str = "Vectorized artwork") -> bytes:
    scale = 72 / dpi
    stream = content(traced, scale, precision, background)
    box = f"[0 0 {fixed(traced.width * scale, 4)} {fixed(traced.height * scale, 4)}]"
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox {box} /Contents 4 0 R /Resources << >> >>",
        f"<< /Length {len(stream.encode('latin-1', 'replace'))} >>\nstream\n{stream}\nendstream",
        f"<< /Title ({escape(title)}) >>",
    ]
    head = "%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"
    bodies = [f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1)]
    size = lambda s: len(s.encode("latin-1", "replace"))
    offsets = list(accumulate(map(size, bodies), initial=size(head)))
    table = "".join(f"{o:010d} 00000 n \n" for o in offsets[:-1])
    tail = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info 5 0 R >>\nstartxref\n{offsets[-1]}\n%%EOF\n"
    return (head + "".join(bodies) + tail).encode("latin-1", "replace")
