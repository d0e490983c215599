"""Colour spaces and differences on numpy arrays."""

from __future__ import annotations

import numpy as np

# The sRGB/D65 matrices, white point and CIE constants.
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.072175], [0.0193339, 0.119192, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
KNEE = 6 / 29


def linear(channel: np.ndarray) -> np.ndarray:
    """Linear light of 8-bit values, rounded to single precision as a lookup table would hold it."""
    c = np.asarray(channel, float) / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    return lin.astype(np.float32).astype(float)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) of rows of 8-bit RGB."""
    t = linear(np.atleast_2d(rgb)) @ TO_XYZ.T / WHITE
    f = np.where(t > KNEE**3, np.cbrt(t), t / (3 * KNEE**2) + 4 / 29)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def ciede2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 between rows of Lab, with unit weights; the formula of Sharma, Wu and Dalal (2005)."""
    p, q = np.atleast_2d(p), np.atleast_2d(q)
    c7 = ((np.hypot(p[:, 1], p[:, 2]) + np.hypot(q[:, 1], q[:, 2])) / 2) ** 7
    g = 1 + 0.5 * (1 - np.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = g * p[:, 1], g * q[:, 1]
    c1, c2 = np.hypot(a1, p[:, 2]), np.hypot(a2, q[:, 2])

    def hue(b, a):
        h = np.degrees(np.arctan2(b, a))
        return np.where((a == 0) & (b == 0), 0.0, np.where(h < 0, h + 360, h))

    h1, h2 = hue(p[:, 2], a1), hue(q[:, 2], a2)
    both = c1 * c2 != 0
    dh = h2 - h1
    dh = np.where(~both, 0.0, np.where(dh > 180, dh - 360, np.where(dh < -180, dh + 360, dh)))
    dl, dc = q[:, 0] - p[:, 0], c2 - c1
    dbig = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh) / 2)
    lm, cm, total = (p[:, 0] + q[:, 0]) / 2, (c1 + c2) / 2, h1 + h2
    hm = np.where(~both, total, np.where(np.abs(h1 - h2) <= 180, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    cos = lambda deg: np.cos(np.radians(deg))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
    l50 = (lm - 50) ** 2
    sl, sc, sh = 1 + 0.015 * l50 / np.sqrt(20 + l50), 1 + 0.045 * cm, 1 + 0.015 * cm * t
    cm7 = cm**7
    turn = -2 * np.sqrt(cm7 / (cm7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    return np.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (dbig / sh) ** 2 + turn * (dc / sc) * (dbig / sh))


def hex_of(rgb) -> str:
    return "#%02x%02x%02x" % tuple(int(v) for v in rgb)


def rgb_of(text: str) -> tuple[int, int, int]:
    """``#rgb`` or ``#rrggbb``, with or without the sign."""
    s = text.strip().removeprefix("#").lower()
    if len(s) == 3:
        s = "".join(c * 2 for c in s)
    if len(s) != 6 or any(c not in "0123456789abcdef" for c in s):
        raise ValueError(f"not a colour: {text!r}")
    return int(s[:2], 16), int(s[2:4], 16), int(s[4:], 16)


#: Upper hue limits of the basic names.
HUES = (
    (15, "Red"), (40, "Orange"), (65, "Yellow"), (95, "Lime"), (150, "Green"), (185, "Teal"),
    (210, "Cyan"), (250, "Blue"), (280, "Indigo"), (310, "Purple"), (340, "Pink"), (360, "Red"),
)
#: Greys by least lightness, below chroma 0.08.
GREYS = ((0.96, "White"), (0.75, "Light grey"), (0.45, "Grey"), (0.15, "Dark grey"))


def name_of(rgb) -> str:
    """A short name such as ``Dark teal``'s kin: grey by lightness, else hue with a modifier."""
    r, g, b = (int(v) for v in rgb)
    top, low = max(r, g, b), min(r, g, b)
    light, chroma = (top + low) / 2 / 255, (top - low) / 255
    if chroma < 0.08:
        return next((n for least, n in GREYS if light > least), "Black")
    span = top - low
    hue = 60 * ((g - b) / span if top == r else 2 + (b - r) / span if top == g else 4 + (r - g) / span)
    hue += 360 * (hue < 0)
    base = next((n for limit, n in HUES if hue < limit), "Red")
    if light > 0.82:
        return "Pale " + base
    if light > 0.62:
        return "Light " + base
    if light < 0.2:
        return "Deep " + base
    if light < 0.38:
        return "Dark " + base
    return "Vivid " + base if chroma > 0.7 else base


def distinct_names(names: list[str]) -> list[str]:
    """Names that repeat get a number each, in order."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if names.count(n) > 1:
            seen[n] = seen.get(n, 0) + 1
            out.append(f"{n} {seen[n]}")
        else:
            out.append(n)
    return out
