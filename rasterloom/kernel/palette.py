"""Reducing an image to a palette: exact colours where there are few, else weighted k-means in Lab."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rasterloom.kernel.color import ciede2000, lab

# Fixed values of the reduction.
MOST_EXACT = 8192  # distinct colours up to which colours are taken as they are
LEAST_COVERAGE, HEADROOM = 0.9, 6  # exact palettes cover this much, or there are at most so many times the wanted colours
BLEND_SHARE, BLEND_DISTANCE = 0.02, 5.0  # a rarer colour this near to a segment between chosen ones is a blend of them
CLEARLY = 1e-9  # a later candidate has to be better by more than this


@dataclass
class Reduced:
    palette: np.ndarray  # (n, 3) of 8-bit RGB
    counts: np.ndarray
    labels: np.ndarray  # (h, w), -1 where transparent
    exact: bool


def _round(x):
    return np.floor(np.asarray(x) + 0.5)


def exact_colours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct 24-bit colours by falling count, ties by first pixel; None if there are too many."""
    values, first, counts = np.unique(codes, return_index=True, return_counts=True)
    if len(values) > MOST_EXACT:
        return None
    order = np.lexsort((first, -counts))
    return values[order], counts[order]


def _to_segments(p: np.ndarray, ends: np.ndarray) -> float:
    """Least distance of a point to any segment between two rows of ``ends``."""
    i, j = np.triu_indices(len(ends), 1)
    a, d = ends[i], ends[j] - ends[i]
    size = (d * d).sum(axis=1)
    t = np.where(size < 1e-9, 0, np.clip(((p - a) * d).sum(axis=1) / np.where(size < 1e-9, 1, size), 0, 1))
    return float(np.sqrt((((a + t[:, None] * d) - p) ** 2).sum(axis=1)).min())


def choose_exact(values: np.ndarray, counts: np.ndarray, most: int, merge: float) -> np.ndarray | None:
    """The chosen colours (24-bit) by greedy passes over falling counts, or None if they cover too little."""
    rgb = np.stack([values >> 16, values >> 8 & 255, values & 255], axis=1)
    points, total = lab(rgb), counts.sum()
    chosen: list[int] = []
    for i in range(len(values)):
        if len(chosen) >= most:
            break
        if chosen:
            if (ciede2000(np.repeat(points[i : i + 1], len(chosen), 0), points[chosen]) < merge).any():
                continue
            if len(chosen) >= 2 and counts[i] <= BLEND_SHARE * total and _to_segments(points[i], points[chosen]) < BLEND_DISTANCE:
                continue
        chosen.append(i)
    if counts[chosen].sum() < LEAST_COVERAGE * total and len(values) > HEADROOM * most:
        return None
    return rgb[chosen]


class Mulberry:
    """The 32-bit generator mulberry32, in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def _clear_argmin(d: np.ndarray) -> np.ndarray:
    """For each row the first column that no later one beats by more than ``CLEARLY``."""
    best, at = d[:, 0].copy(), np.zeros(len(d), np.int64)
    for c in range(1, d.shape[1]):
        better = d[:, c] < best - CLEARLY
        best[better], at[better] = d[better, c], c
    return at


def kmeans(codes: np.ndarray, most: int, seed: int, merge: float, rounds: int = 40) -> np.ndarray:
    """Palette by weighted k-means++ over 15-bit bins (Lab means weighted by pixels), near-equal colours merged."""
    rgb = np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1).astype(float)
    bins = (codes >> 19 << 10) | ((codes >> 11 & 31) << 5) | (codes >> 3 & 31)
    _, first, inverse = np.unique(bins, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    inverse = rank[inverse]
    n = len(first)
    weight = np.bincount(inverse, minlength=n).astype(float)
    mean = lambda v: np.stack([np.bincount(inverse, v[:, i], n) for i in range(3)], axis=1) / weight[:, None]
    points, colours = mean(lab(rgb)), mean(rgb)
    k, draw = min(most, n), Mulberry(seed)
    centers = [points[int(weight.argmax())]]
    near = ((points - centers[0]) ** 2).sum(axis=1)
    for c in range(1, k):
        mass = near * weight
        total = mass.sum()
        if total <= 0:
            pick = c % n
        else:
            pick = min(int(np.searchsorted(np.cumsum(mass), draw() * total, side="left")), n - 1)
        centers.append(points[pick])
        near = np.minimum(near, ((points - points[pick]) ** 2).sum(axis=1))
    centers, owner = np.array(centers), None
    for _ in range(rounds):
        new = _clear_argmin(((points[:, None] - centers[None]) ** 2).sum(axis=2))
        if owner is not None and (new == owner).all():
            break
        owner = new
        mass = np.bincount(owner, weight, k)
        held = mass > 0
        for i in range(3):
            centers[held, i] = np.bincount(owner, weight * points[:, i], k)[held] / mass[held]
    mass = np.bincount(owner, weight, k)
    held = np.flatnonzero(mass > 0)
    out = _round(np.stack([np.bincount(owner, weight * colours[:, i], k)[held] / mass[held] for i in range(3)], axis=1))
    return merge_similar(out.astype(np.int64), mass[held], merge)


def merge_similar(colours: np.ndarray, weights: np.ndarray, limit: float) -> np.ndarray:
    """Merge, heaviest first, each first pair nearer than ``limit`` into the heavier colour, until there is none."""
    colours, weights = np.asarray(colours), np.asarray(weights, float)
    while True:
        order = np.argsort(-weights, kind="stable")
        colours, weights = colours[order], weights[order]
        i, j = np.triu_indices(len(colours), 1)
        if not len(i):
            return colours
        points = lab(colours)
        near = np.flatnonzero(ciede2000(points[i], points[j]) < limit - CLEARLY)
        if not len(near):
            return colours
        a, b = i[near[0]], j[near[0]]
        weights[a] += weights[b]
        colours, weights = np.delete(colours, b, 0), np.delete(weights, b)


def assign(codes: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Palette index of each colour: its own entry (the last, if repeated), else the nearest in Lab.

    Nearness is decided once for each 15-bit key, by the first pixel in scan order whose colour isn't
    an entry; all such pixels of that key follow.
    """
    packed = palette[:, 0] << 16 | palette[:, 1] << 8 | palette[:, 2]
    own = {int(c): i for i, c in enumerate(packed)}
    values, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    label = np.array([own.get(int(v), -1) for v in values], np.int64)
    free = np.flatnonzero(label < 0)
    if len(free):
        keys = (values[free] >> 19 << 10) | ((values[free] >> 11 & 31) << 5) | (values[free] >> 3 & 31)
        order = np.lexsort((first[free], keys))
        lead = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        deciders = values[free][order][lead]
        rgb = np.stack([deciders >> 16, deciders >> 8 & 255, deciders & 255], axis=1)
        distance = ((lab(rgb)[:, None] - lab(palette)[None]) ** 2).sum(axis=2)
        label[free[order]] = _clear_argmin(distance)[np.cumsum(lead) - 1]
    return label[inverse]


def reduce_colours(rgba: np.ndarray, most: int = 8, merge: float = 6, alpha: int = 128, seed: int = 24301, forced: list | None = None) -> Reduced:
    """Palette, counts and label map of an (h, w, 4) image."""
    opaque = rgba[..., 3] >= alpha
    labels = np.full(opaque.shape, -1, np.int64)
    px = rgba[opaque].astype(np.int64)
    codes = px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]
    if not len(codes):
        return Reduced(np.empty((0, 3), np.int64), np.empty(0, np.int64), labels, True)
    exact = True
    if forced:
        palette = np.array(forced[:4096], np.int64)
    else:
        found = exact_colours(codes)
        palette = choose_exact(*found, most, merge) if found else None
        if palette is None:
            palette, exact = kmeans(codes, most, seed, merge), False
    at = assign(codes, palette)
    counts = np.bincount(at, minlength=len(palette))
    if not forced and (counts == 0).any():
        index = np.cumsum(counts > 0) - 1
        palette, at, counts = palette[counts > 0], index[at], counts[counts > 0]
    labels[opaque] = at
    return Reduced(palette, counts, labels, exact)
