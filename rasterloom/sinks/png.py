"""PNG writing, and previews by scan conversion of flattened outlines."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.kernel.color import rgb_of
from rasterloom.kernel.fit import flatten


def encode(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) array of 8-bit RGBA as PNG."""
    h, w = rgba.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)), axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def winding(h: int, w: int, outlines: list[list[tuple[float, float]]]) -> np.ndarray:
    """Winding number at each pixel's centre."""
    turns = np.zeros((h, w + 1), np.int32)
    for points in outlines:
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            if ay == by:
                continue
            up = 1 if ay < by else -1
            lo, hi = min(ay, by), max(ay, by)
            rows = np.arange(max(0, int(np.ceil(lo - 0.5))), min(h, int(np.ceil(hi - 0.5))))
            x = ax + (rows + 0.5 - ay) * (bx - ax) / (by - ay)
            np.add.at(turns, (rows, np.clip(np.ceil(x - 0.5), 0, w).astype(int)), up)
    return turns.cumsum(axis=1)[:, :w]


#: Places within a pixel where an anti-aliased preview is sampled, from its centre: a turned grid of four.
SAMPLES = ((-0.125, -0.375), (0.375, -0.125), (0.125, 0.375), (-0.375, 0.125))


def draw(traced, width: int | None = None, background: str | None = None, smooth: bool = False) -> np.ndarray:
    """Layers over each other as 8-bit RGBA; strokes as discs along their flattened path.

    ``smooth`` averages four samples a pixel, weighted by their cover; else a pixel is what its centre is.
    """
    scale = (width or traced.width) / traced.width
    w, h = max(1, round(traced.width * scale)), max(1, round(traced.height * scale))
    place = lambda path: [(x * scale, y * scale) for x, y in flatten(path)]
    parts = [
        ([place(c.path) for s in layer.shapes for c in s.contours], [(place(s.path), s.closed, s.width * scale / 2) for s in layer.strokes], layer.color)
        for layer in traced.layers
    ]
    if not smooth:
        return _sample(h, w, parts, background, 0.0, 0.0)
    total = np.zeros((h, w, 4), np.uint32)
    for dx, dy in SAMPLES:
        one = _sample(h, w, parts, background, dx, dy).astype(np.uint32)
        one[..., :3] *= one[..., 3:] // 255
        total += one
    cover = np.maximum(total[..., 3:] // 255, 1)
    return np.concatenate(((total[..., :3] + cover // 2) // cover, (total[..., 3:] + 2) // 4), axis=2).astype(np.uint8)


def _sample(h: int, w: int, parts: list, background: str | None, dx: float, dy: float) -> np.ndarray:
    """Every pixel as it is at ``(dx, dy)`` from its centre, wholly covered or not at all."""
    out = np.zeros((h, w, 4), np.uint8)
    if background:
        out[:] = (*rgb_of(background), 255)
    for outlines, strokes, color in parts:
        on = winding(h, w, [[(x - dx, y - dy) for x, y in o] for o in outlines]) != 0 if outlines else np.zeros((h, w), bool)
        for p, closed, radius in strokes:
            for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1] * closed):
                # Only the pixels around the piece can be on it.
                top, left = max(0, int(min(ay, by) - radius - 1)), max(0, int(min(ax, bx) - radius - 1))
                box = np.s_[top : max(top, int(max(ay, by) + radius + 2)), left : max(left, int(max(ax, bx) + radius + 2))]
                here = on[box]
                yy, xx = np.mgrid[: here.shape[0], : here.shape[1]]
                yy, xx = yy + (top + 0.5 + dy), xx + (left + 0.5 + dx)
                ex, ey = bx - ax, by - ay
                t = np.clip(((xx - ax) * ex + (yy - ay) * ey) / max(ex * ex + ey * ey, 1e-12), 0, 1)
                here |= (xx - ax - t * ex) ** 2 + (yy - ay - t * ey) ** 2 <= radius**2
        out[on] = (*color, 255)
    return out


def preview(traced, width: int | None = None, background: str | None = None, smooth: bool = True) -> bytes:
    return encode(draw(traced, width, background, smooth))
