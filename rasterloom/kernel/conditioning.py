"""Pixel conditioning of one image: scaling, alpha, median, noise. (h, w, 4) arrays of 8-bit RGBA."""

from __future__ import annotations

import math

import numpy as np


def downscale(rgba: np.ndarray, most: float) -> tuple[np.ndarray, float]:
    """Area average to at most ``most`` pixels a side, colours weighted by alpha; and the scale."""
    h, w = rgba.shape[:2]
    if not math.isfinite(most) or most <= 0 or max(h, w) <= most:
        return rgba, 1.0
    scale = most / max(h, w)
    ow, oh = max(1, math.floor(w * scale + 0.5)), max(1, math.floor(h * scale + 0.5))

    def spans(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(out)
        low = np.floor(at * (size / out)).astype(np.int64)
        return low, np.minimum(size, np.maximum(low + 1, np.ceil((at + 1) * (size / out)).astype(np.int64)))

    (x0, x1), (y0, y1) = spans(w, ow), spans(h, oh)
    alpha = rgba[..., 3].astype(float)
    planes = np.dstack([rgba[..., :3] * (alpha / 255)[..., None], alpha])
    table = np.zeros((h + 1, w + 1, 4))
    table[1:, 1:] = planes.cumsum(axis=0).cumsum(axis=1)
    sums = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
    size = (y1 - y0)[:, None] * (x1 - x0)[None]
    weight = sums[..., 3:] / 255
    seen = weight[..., 0] > 1e-9
    colour = np.where(seen[..., None], sums[..., :3] / np.where(seen[..., None], weight, 1), 0)
    # Prefix sums carry rounding errors of about 1e-9, which must not turn a half down.
    out = np.floor(np.dstack([colour, np.where(seen, sums[..., 3] / size, 0)]) + 0.5 + 1e-7)
    return np.clip(out, 0, 255).astype(np.uint8), ow / w


def harden(rgba: np.ndarray, least: int) -> np.ndarray:
    out = rgba.copy()
    out[..., 3] = np.where(rgba[..., 3] >= least, 255, 0)
    return out


def median(rgba: np.ndarray, radius: int) -> np.ndarray:
    """Upper median of each channel over the non-transparent pixels of the clipped window; transparent centres stay."""
    if radius < 1:
        return rgba
    h, w = rgba.shape[:2]
    k = 2 * radius + 1
    seen = np.pad(rgba[..., 3] > 0, radius)
    windows = lambda plane: np.lib.stride_tricks.sliding_window_view(plane, (k, k)).reshape(h, w, k * k)
    mask = windows(seen)
    n, out = mask.sum(axis=2), rgba.copy()
    centre = rgba[..., 3] > 0
    for c in range(3):
        values = np.where(mask, windows(np.pad(rgba[..., c].astype(np.int16), radius)), 999)
        values.sort(axis=2)
        picked = np.take_along_axis(values, (n // 2)[..., None].clip(0, k * k - 1), axis=2)[..., 0]
        out[..., c] = np.where(centre, picked, rgba[..., c])
    return out


def _row3(op, plane: np.ndarray) -> np.ndarray:
    """The extreme of three neighbours in each row, for inner columns."""
    return op(op(plane[:, :-2], plane[:, 1:-1]), plane[:, 2:])


def _around(op, plane: np.ndarray) -> np.ndarray:
    """The extreme of each inner pixel's 3x3 window."""
    rows = _row3(op, plane)
    return op(op(rows[:-2], rows[1:-1]), rows[2:])


def noise(rgba: np.ndarray) -> float:
    """How noisy flat areas are and how often pixels overshoot their neighbours, 0 to 1."""
    h, w = rgba.shape[:2]
    if w < 3 or h < 3:
        return 0.0
    step = 2 if w * h > 500_000 else 1
    thin = lambda plane: plane[::step, ::step]
    usable = thin(_around(np.minimum, rgba[..., 3]) >= 250)
    if not usable.any():
        return 0.0
    r, g, b = (np.ascontiguousarray(rgba[..., i]) for i in range(3))
    spread = _around(np.maximum, np.maximum(np.maximum(r, g), b)) - _around(np.minimum, np.minimum(np.minimum(r, g), b))
    flat = usable & (thin(spread) <= 24)
    luma = 299 * r.astype(np.int32) + 587 * g.astype(np.int32) + 114 * b.astype(np.int32)  # in thousandths, exactly
    inner = luma[1:-1, 1:-1]

    def ring(op) -> np.ndarray:
        rows = _row3(op, luma)
        return op(op(rows[:-2], rows[2:]), op(luma[1:-1, :-2], luma[1:-1, 2:]))

    over = usable & thin((inner > ring(np.maximum) + 4000) | (inner < ring(np.minimum) - 4000))
    deviation = 0
    for c in (r, g, b):
        left, here, right = (thin(c[1:-1, i : i + w - 2])[flat].astype(np.int16) for i in range(3))
        low, high = np.minimum(left, right), np.maximum(left, right)
        deviation += int(np.abs(here - np.clip(here, low, high)).sum(dtype=np.int64))
    signal = deviation / (3 * int(flat.sum())) / 12 if flat.any() else 0.0
    return float(min(1.0, max(signal / 0.02, over.sum() / usable.sum() / 0.006)))


def denoise_radius(level: float, width: int, height: int) -> int:
    if level <= 10:
        return 0
    return min(2 if level >= 75 else 1, 1 if max(width, height) < 320 else 2)
