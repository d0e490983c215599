"""Colour functions as Column expressions: no UDF, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.kernel.color import GREYS, HUES, KNEE, TO_XYZ, WHITE
from rasterloom.sinks.dxf import ACI


def half_up(v: Column) -> Column:
    """Nearest whole number, halves up, as bigint."""
    return F.floor(v + 0.5)


def round_half_up(v: Column, digits: int) -> Column:
    return F.floor(v * 10.0**digits + 0.5) / 10.0**digits


def srgb_to_linear(channel: Column) -> Column:
    """Linear light of an 8-bit channel, at single precision."""
    c = channel.cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))).cast("float").cast("double")


def linear_to_srgb8(v: Column) -> Column:
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(s * 255))).cast("int")


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """``struct<L, a, b>`` under D65."""
    light = [srgb_to_linear(c) for c in (r, g, b)]

    def f(row, white: float) -> Column:
        t = sum((F.lit(float(k)) * c for k, c in zip(row[1:], light[1:])), F.lit(float(row[0])) * light[0]) / float(white)
        return F.when(t > KNEE**3, F.cbrt(t)).otherwise(t / (3 * KNEE**2) + 4 / 29)

    fx, fy, fz = (f(row, white) for row, white in zip(TO_XYZ, WHITE))
    return F.struct((116 * fy - 16).alias("L"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


#: XYZ to linear sRGB.
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))


def lab_to_rgb(lab: Column) -> Column:
    fy = (lab["L"] + 16) / 116
    inverse = lambda t: F.when(t > KNEE, t * t * t).otherwise(3 * KNEE**2 * (t - 4 / 29))
    xyz = [inverse(t) * float(w) for t, w in zip((fy + lab["a"] / 500, fy, fy - lab["b"] / 200), WHITE)]
    rgb = [linear_to_srgb8(reduce(lambda a, b: a + b, [k * v for k, v in zip(row, xyz)])) for row in FROM_XYZ]
    return F.struct(*(c.alias(n) for c, n in zip(rgb, "rgb")))


def delta_e76(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in ("a", "b")), (p["L"] - q["L"]) * (p["L"] - q["L"])))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: Column expressions otherwise repeat what they share."""
    return F.element_at(F.transform(F.array(value), then), 1)


def delta_e2000(p: Column, q: Column) -> Column:
    """CIEDE2000 with unit weights (Sharma, Wu and Dalal, 2005)."""
    k7 = 6103515625.0
    chroma = lambda a, b: F.sqrt(a * a + b * b)
    cos = lambda v: F.cos(F.radians(v))

    def hue(b: Column, a: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)

    def stretched(v: Column) -> Column:
        c7 = F.pow((chroma(v["p"]["a"], v["p"]["b"]) + chroma(v["q"]["a"], v["q"]["b"])) / 2, F.lit(7.0))
        g = 1 + 0.5 * (1 - F.sqrt(c7 / (c7 + k7)))
        return let(
            F.struct((g * v["p"]["a"]).alias("a1"), (g * v["q"]["a"]).alias("a2"), v["p"]["b"].alias("b1"), v["q"]["b"].alias("b2"), v["p"]["L"].alias("l1"), v["q"]["L"].alias("l2")), polar
        )

    def polar(v: Column) -> Column:
        return let(
            F.struct(
                chroma(v["a1"], v["b1"]).alias("c1"), chroma(v["a2"], v["b2"]).alias("c2"), hue(v["b1"], v["a1"]).alias("h1"), hue(v["b2"], v["a2"]).alias("h2"),
                (v["l2"] - v["l1"]).alias("dl"), ((v["l1"] + v["l2"]) / 2 - 50).alias("l50"),
            ),
            means,
        )

    def means(v: Column) -> Column:
        grey, d, total = v["c1"] * v["c2"] == 0, v["h2"] - v["h1"], v["h1"] + v["h2"]
        dh = F.when(grey, 0.0).when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
        hm = F.when(grey, total).when(F.abs(d) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return let(
            F.struct(
                dh.alias("dh"), hm.alias("hm"), ((v["c1"] + v["c2"]) / 2).alias("cm"), (v["c2"] - v["c1"]).alias("dc"), F.sqrt(v["c1"] * v["c2"]).alias("cc"), v["dl"].alias("dl"), (v["l50"] * v["l50"]).alias("l2")
            ),
            weighted,
        )

    def weighted(v: Column) -> Column:
        hm, cm7, bend = v["hm"], F.pow(v["cm"], F.lit(7.0)), (v["hm"] - 275) / 25
        t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
        turn = -2 * F.sqrt(cm7 / (cm7 + k7)) * F.sin(F.radians(60 * F.exp(-(bend * bend))))
        return let(
            F.struct(
                (v["dl"] / (1 + 0.015 * v["l2"] / F.sqrt(20 + v["l2"]))).alias("a"), (v["dc"] / (1 + 0.045 * v["cm"])).alias("b"),
                (2 * v["cc"] * F.sin(F.radians(v["dh"]) / 2) / (1 + 0.015 * v["cm"] * t)).alias("c"), turn.alias("turn"),
            ),
            lambda w: F.sqrt(F.greatest(F.lit(0.0), w["a"] * w["a"] + w["b"] * w["b"] + w["c"] * w["c"] + w["turn"] * w["b"] * w["c"])),
        )

    return let(F.struct(p.alias("p"), q.alias("q")), stretched)


def pack24(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))).cast("int")


def pack15(r: Column, g: Column, b: Column) -> Column:
    """Five bits of each channel."""
    five = lambda c: F.shiftright(c.cast("int"), 3)
    return F.shiftleft(five(r), 10).bitwiseOR(F.shiftleft(five(g), 5)).bitwiseOR(five(b))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    byte = lambda c: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), half_up(c.cast("double")))))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def from_hex(text: Column) -> Column:
    """``struct<r, g, b>`` of ``#rgb`` or ``#rrggbb``; null if it is no colour."""
    s = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    s = F.when(F.length(s) == 3, F.regexp_replace(s, "(.)", "$1$1")).otherwise(s)
    part = lambda i: F.conv(F.substring(s, i, 2), 16, 10).cast("int")
    return F.when(s.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * srgb_to_linear(r) + 0.7152 * srgb_to_linear(g) + 0.0722 * srgb_to_linear(b)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def channel_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return F.greatest(*(F.abs(a - b) for a, b in zip(p, q)))


def color_name(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, chroma, span = (top + low) / 2.0 / 255.0, (top - low) / 255.0, (top - low).cast("double")
    grey = F.lit("Black")
    for least, name in reversed(GREYS):
        grey = F.when(light > least, F.lit(name)).otherwise(grey)
    turn = F.when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
    hue = F.when(turn < 0, turn + 360).otherwise(turn)
    base = F.lit("Red")
    for limit, name in reversed(HUES):
        base = F.when(hue < limit, F.lit(name)).otherwise(base)
    kind = F.when(light > 0.82, "Pale ").when(light > 0.62, "Light ").when(light < 0.2, "Deep ").when(light < 0.38, "Dark ").when(chroma > 0.7, "Vivid ").otherwise("")
    return F.when(chroma < 0.08, grey).otherwise(F.concat(kind, base))


def nearest_aci(r: Column, g: Column, b: Column) -> Column:
    """The entry of the fixed colour index at the least squared distance, the first of equals."""
    entries = F.array(
        *(
            F.struct(((r - c[0]) * (r - c[0]) + (g - c[1]) * (g - c[1]) + (b - c[2]) * (b - c[2])).alias("d"), F.lit(i).alias("o"), F.lit(aci).alias("aci"))
            for i, (aci, c) in enumerate(ACI)
        )
    )
    return F.array_min(entries)["aci"]


def distance_to_segment(p: Column, a: Column, b: Column) -> Column:
    """Euclidean distance in Lab of a point to a segment."""
    keys = ("L", "a", "b")
    dot = lambda u, v: sum((u[k] * v[k] for k in keys[1:]), u["L"] * v["L"])
    sub = lambda u, v: {k: u[k] - v[k] for k in keys}
    d, q = sub(b, a), sub(p, a)
    size = dot(d, d)
    t = F.when(size < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(q, d) / size)))
    rest = {k: q[k] - t * d[k] for k in keys}
    return F.sqrt(dot(rest, rest))
