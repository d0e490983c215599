"""The library's functions for SQL, under the prefix ``rl_``: SQL functions over built-ins, so they are inlined."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rasterloom.kernel.color import GREYS, HUES, KNEE, TO_XYZ, WHITE

_LINEAR = "CAST(CAST(CASE WHEN c / 255D <= 0.04045D THEN c / 255D / 12.92D ELSE power((c / 255D + 0.055D) / 1.055D, 2.4D) END AS FLOAT) AS DOUBLE)"


def _d(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lab() -> str:
    light = ("v.r", "v.g", "v.b")
    t = ["(" + " + ".join(f"{_d(k)} * {c}" for k, c in zip(row, light)) + f") / {_d(w)}" for row, w in zip(TO_XYZ, WHITE)]
    f = [f"CASE WHEN {x} > {_d(KNEE**3)} THEN cbrt({x}) ELSE {x} / {_d(3 * KNEE**2)} + {_d(4 / 29)} END" for x in t]
    body = _let("w", f"named_struct('x', {f[0]}, 'y', {f[1]}, 'z', {f[2]})", "named_struct('L', 116D * w.y - 16D, 'a', 500D * (w.x - w.y), 'b', 200D * (w.y - w.z))")
    return _let("v", "named_struct('r', rl_srgb_to_linear(r), 'g', rl_srgb_to_linear(g), 'b', rl_srgb_to_linear(b))", body)


def _delta_e2000() -> str:
    """CIEDE2000 of two ``struct<L, a, b>``."""
    root7 = lambda c: f"sqrt(power({c}, 7D) / (power({c}, 7D) + 6103515625D))"
    hue = lambda b, a: f"CASE WHEN {a} = 0D AND {b} = 0D THEN 0D WHEN degrees(atan2({b}, {a})) < 0D THEN degrees(atan2({b}, {a})) + 360D ELSE degrees(atan2({b}, {a})) END"
    cos = lambda v: f"cos(radians({v}))"
    last = "sqrt(greatest(0D, z.a * z.a + z.b * z.b + z.c * z.c + z.t * z.b * z.c))"
    weighted = (
        f"named_struct('a', y.dl / (1D + 0.015D * y.l2 / sqrt(20D + y.l2)), 'b', y.dc / (1D + 0.045D * y.cm), 'c', 2D * y.cc * sin(radians(y.dh) / 2D) / (1D + 0.015D * y.cm * "
        f"(1D - 0.17D * {cos('y.hm - 30D')} + 0.24D * {cos('2D * y.hm')} + 0.32D * {cos('3D * y.hm + 6D')} - 0.2D * {cos('4D * y.hm - 63D')})), "
        f"'t', -2D * {root7('y.cm')} * sin(radians(60D * exp(-((y.hm - 275D) / 25D) * ((y.hm - 275D) / 25D)))))"
    )
    means = (
        "named_struct('dh', CASE WHEN x.c1 * x.c2 = 0D THEN 0D WHEN x.h2 - x.h1 > 180D THEN x.h2 - x.h1 - 360D WHEN x.h2 - x.h1 < -180D THEN x.h2 - x.h1 + 360D ELSE x.h2 - x.h1 END, "
        "'hm', CASE WHEN x.c1 * x.c2 = 0D THEN x.h1 + x.h2 WHEN abs(x.h2 - x.h1) <= 180D THEN (x.h1 + x.h2) / 2D WHEN x.h1 + x.h2 < 360D THEN (x.h1 + x.h2 + 360D) / 2D ELSE (x.h1 + x.h2 - 360D) / 2D END, "
        "'cm', (x.c1 + x.c2) / 2D, 'dc', x.c2 - x.c1, 'cc', sqrt(x.c1 * x.c2), 'dl', q.L - p.L, 'l2', ((p.L + q.L) / 2D - 50D) * ((p.L + q.L) / 2D - 50D))"
    )
    polar = f"named_struct('c1', hypot(v.a1, p.b), 'c2', hypot(v.a2, q.b), 'h1', {hue('p.b', 'v.a1')}, 'h2', {hue('q.b', 'v.a2')})"
    stretched = "named_struct('a1', (1D + u) * p.a, 'a2', (1D + u) * q.a)"
    g = f"0.5D * (1D - {root7('((hypot(p.a, p.b) + hypot(q.a, q.b)) / 2D)')})"
    return _let("u", g, _let("v", stretched, _let("x", polar, _let("y", means, _let("z", weighted, last)))))


def _color_name() -> str:
    hue = "60D * CASE WHEN v.top = r THEN (g - b) / v.span WHEN v.top = g THEN 2D + (b - r) / v.span ELSE 4D + (r - g) / v.span END"
    light, chroma = "((v.top + v.low) / 510D)", "((v.top - v.low) / 255D)"
    grey = "CASE " + " ".join(f"WHEN {light} > {_d(least)} THEN '{n}'" for least, n in GREYS) + " ELSE 'Black' END"
    base = "CASE " + " ".join(f"WHEN (CASE WHEN h < 0D THEN h + 360D ELSE h END) < {limit} THEN '{n}'" for limit, n in HUES) + " ELSE 'Red' END"
    kind = f"CASE WHEN {light} > 0.82D THEN 'Pale ' WHEN {light} > 0.62D THEN 'Light ' WHEN {light} < 0.2D THEN 'Deep ' WHEN {light} < 0.38D THEN 'Dark ' WHEN {chroma} > 0.7D THEN 'Vivid ' ELSE '' END"
    named = f"CASE WHEN {chroma} < 0.08D THEN {grey} ELSE concat({kind}, {_let('h', hue, base)}) END"
    return _let("v", "named_struct('top', greatest(r, g, b), 'low', least(r, g, b), 'span', CAST(greatest(1, greatest(r, g, b) - least(r, g, b)) AS DOUBLE))", named)


_LAB = "STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE>"
#: name, parameters, result, body
FUNCTIONS = (
    ("rl_srgb_to_linear", "c INT", "DOUBLE", _LINEAR),
    ("rl_luminance", "r INT, g INT, b INT", "DOUBLE", "0.2126D * rl_srgb_to_linear(r) + 0.7152D * rl_srgb_to_linear(g) + 0.0722D * rl_srgb_to_linear(b)"),
    ("rl_luma", "r INT, g INT, b INT", "DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b"),
    ("rl_hex", "r INT, g INT, b INT", "STRING", "concat('#', lpad(lower(hex(r * 65536 + g * 256 + b)), 6, '0'))"),
    ("rl_delta_e76", "l1 DOUBLE, a1 DOUBLE, b1 DOUBLE, l2 DOUBLE, a2 DOUBLE, b2 DOUBLE", "DOUBLE", "sqrt((l1-l2)*(l1-l2) + (a1-a2)*(a1-a2) + (b1-b2)*(b1-b2))"),
    ("rl_rgb_to_lab", "r INT, g INT, b INT", _LAB, _lab()),
    ("rl_delta_e2000", f"p {_LAB}, q {_LAB}", "DOUBLE", _delta_e2000()),
    ("rl_color_name", "r INT, g INT, b INT", "STRING", _color_name()),
    ("rl_epsilon", "detail DOUBLE", "DOUBLE", "CASE WHEN detail >= 99.5D THEN 0D ELSE 0.55D + 2.6D * power((100D - detail) / 100D, 1.3D) END"),
    ("rl_corner_degrees", "smoothing DOUBLE", "DOUBLE", "8D + 92D * power(smoothing / 100D, 0.9D)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
