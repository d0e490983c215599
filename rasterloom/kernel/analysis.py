"""Whether an image suits tracing: measurements, class, score, findings and recommended settings."""

from __future__ import annotations

import math

import numpy as np

from rasterloom.kernel.conditioning import noise

# Fixed values of the measurements.
MOST_COLOURS, SOFT, HARD, OPAQUE = 20_000, 10, 40, 128
#: Points taken off below these least sides.
SMALL_SIDES = ((64, 25), (128, 12), (200, 5))
#: Verdict by least score.
VERDICTS = ((80, "excellent"), (62, "good"), (35, "fair"))


def _round(v: float, digits: int = 0) -> float:
    return math.floor(v * 10**digits + 0.5) / 10**digits


def measure(rgba: np.ndarray) -> dict:
    h, w = rgba.shape[:2]
    if not h or not w:
        raise ValueError("the image is empty")
    step = 3 if w * h > 1_500_000 else 2 if w * h > 400_000 else 1
    jump = np.zeros((h, w), np.uint8)
    for i in range(3):
        c = np.ascontiguousarray(rgba[..., i])
        for at, one, two in ((jump[:, :-1], c[:, 1:], c[:, :-1]), (jump[:-1], c[1:], c[:-1])):
            np.maximum(at, np.maximum(one, two) - np.minimum(one, two), out=at)
    opaque = rgba[::step, ::step, 3] >= OPAQUE
    jump, c = jump[::step, ::step][opaque], rgba[::step, ::step, :3][opaque].astype(np.int32)
    n, sampled = max(1, len(jump)), opaque.size
    colours = int(np.bincount(c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2], minlength=1).astype(bool).sum()) if len(c) > 1 << 20 else len(np.unique(c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]))
    return {
        "transparent": 1 - len(jump) / sampled, "colours": min(colours, MOST_COLOURS), "capped": colours >= MOST_COLOURS,
        "flat": (jump == 0).sum() / n, "soft": ((jump > 0) & (jump <= SOFT)).sum() / n, "hard": (jump >= HARD).sum() / n, "noise": noise(rgba),
    }


def classify(flat: float, soft: float, colours: int, capped: bool) -> str:
    if flat < 0.2 and soft > 0.55 or capped and flat < 0.35:
        return "photo"
    if flat >= 0.6:
        return "line-art" if colours <= 8 else "flat-art"
    if flat >= 0.3:
        return "gradient-art" if soft > 0.45 or colours > 4000 else "flat-art"
    return "gradient-art" if soft > 0.4 else "unknown"


def score(kind: str, flat: float, soft: float, capped: bool, width: int, height: int) -> tuple[int, str]:
    base = {"line-art": 92, "flat-art": 70 + _round(flat * 25), "gradient-art": 45 + _round(flat * 25) - _round(soft * 15), "photo": 12}.get(kind, 45)
    base -= next((off for side, off in SMALL_SIDES if min(width, height) < side), 0) + 8 * (capped and kind != "photo")
    got = int(max(0, min(100, base)))
    return got, next((v for least, v in VERDICTS if got >= least), "poor")


def findings(m: dict, kind: str, width: int, height: int) -> list[tuple[str, str]]:
    """(level, message) in a fixed order."""
    out = [
        {
            "photo": ("error", "Looks like a photograph: there are no flat shapes to trace."),
            "gradient-art": ("warning", "Gradients or soft shading: each band becomes a flat shape."),
            "line-art": ("info", "Line art or a silhouette: few colours, large flat areas; thin strokes can become centrelines."),
            "flat-art": ("info", "Flat artwork with defined shapes, which suits tracing."),
        }.get(kind, ("warning", "The image could not be classified with confidence."))
    ]
    short = min(width, height)
    if short < 64:
        out.append(("error", f"Only {width}x{height} px: too coarse for reliable shapes."))
    elif short < 200:
        out.append(("warning", f"Low resolution ({width}x{height} px): corners and fine detail soften."))
    if m["noise"] > 0.35:
        out.append(("warning", "Heavy speckle, as of a JPEG saved again: keep denoising on."))
    edges = m["hard"] + m["soft"]
    if edges > 0.02 and m["hard"] / edges < 0.12 and kind != "photo":
        out.append(("warning", "Edges are soft, as of a blurred or enlarged source."))
    if m["capped"]:
        out.append(("info", f"More than {MOST_COLOURS:,} distinct colours; they are reduced to the palette."))
    elif m["colours"] <= 24:
        out.append(("info", f"Only {m['colours']} distinct colours, which can be kept exactly."))
    if m["transparent"] > 0.05:
        out.append(("info", f"Has transparency ({_round(m['transparent'] * 100):.0f}% of the canvas)."))
    return out


def recommend(m: dict, kind: str, width: int, height: int) -> tuple[str, dict, str]:
    """(preset, settings over it, why)."""
    n, colours, capped = m["noise"], m["colours"], m["capped"]
    noisy, very = n > 0.15, n > 0.5
    settings: dict = {"denoise": 85 if very else 70 if noisy else 45 if n > 0.05 else 30}
    if noisy:
        settings["color_merge_threshold"] = 14.0 if very else 12.0
    within = lambda lo, hi: max(lo, min(hi, colours))
    if colours <= 32 and max(width, height) <= 256:
        return "pixel-art", {"max_colors": within(2, 32)}, "a small canvas with a tiny palette is traced literally"
    if kind == "line-art":
        return "lineart", {"max_colors": within(2, 4)} | settings, "few colours and large flat areas"
    if kind == "flat-art":
        if colours <= 24 and not capped:
            return "logo", {"max_colors": within(2, 8)} | settings, "a small palette is kept exactly"
        return "ai-art", {"max_colors": 6 if noisy else 10} | settings, "near-equal colours are merged harder"
    if kind == "gradient-art":
        return "poster", {"max_colors": 10 if noisy else 12} | settings, "more colours make less banding"
    if kind == "photo":
        return "poster", {"max_colors": 16, "denoise": 60, "color_merge_threshold": 8.0}, "a posterised reading, not a faithful one"
    return "logo", settings, "balanced defaults"


def analyze(rgba: np.ndarray) -> dict:
    h, w = rgba.shape[:2]
    m = measure(rgba)
    kind = classify(m["flat"], m["soft"], m["colours"], m["capped"])
    points, verdict = score(kind, m["flat"], m["soft"], m["capped"], w, h)
    preset, settings, why = recommend(m, kind, w, h)
    r = lambda k: _round(float(m[k]), 4)
    return {
        "width": w, "height": h, "has_alpha": m["transparent"] > 0.001, "transparent_ratio": r("transparent"), "unique_colors": m["colours"],
        "unique_colors_capped": m["capped"], "flat_ratio": r("flat"), "soft_edge_ratio": r("soft"), "hard_edge_ratio": r("hard"), "noise_estimate": r("noise"),
        "classification": kind, "suitability": verdict, "score": points, "findings": findings(m, kind, w, h),
        "recommended_preset": preset, "recommended": settings, "rationale": why,
    }
