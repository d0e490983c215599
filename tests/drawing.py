"""Synthetic rasters with exact answers."""

import numpy as np


def blank(width, height, color=(0, 0, 0, 0)):
    a = np.zeros((height, width, 4), np.uint8)
    a[:] = color
    return a


def rect(a, x, y, w, h, color):
    a[y : y + h, x : x + w] = (*color, 255)
    return a


def disc(a, cx, cy, r, color):
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    a[(x + 0.5 - cx) ** 2 + (y + 0.5 - cy) ** 2 <= r * r] = color if len(color) == 4 else (*color, 255)
    return a


def photo(n=400):
    y, x = np.mgrid[:n, :n]
    planes = [128 + 60 * np.sin(x / 23) + 50 * np.cos(y / 17 + x / 40), 128 + 80 * np.sin(x / 31 + y / 19), 128 + 90 * np.cos((x + y) / 37), np.full((n, n), 255)]
    return np.dstack(planes).clip(0, 255).astype(np.uint8)
