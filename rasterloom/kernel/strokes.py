"""Centrelines: thin regions as stroked paths with a width, by distance field and skeleton."""

from __future__ import annotations

import math

import numpy as np

from rasterloom.kernel import fit

# Fixed values of the stroke test.
LEAST_PIXELS, MOST_RADIUS, SPUR = 6, 40.0, 1.6
FORCED_ELONGATION = 2.5
FAR = 1e20


def distance_squared(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of every set pixel to the nearest unset one; outside the image is not unset."""
    h, w = mask.shape
    down = np.full((h, w), FAR)
    rows = np.arange(h)[:, None]
    last = np.maximum.accumulate(np.where(mask, -1, rows), axis=0)
    nxt = np.minimum.accumulate(np.where(mask, 2 * h + 1, rows)[::-1], axis=0)[::-1]
    near = np.minimum(np.where(last < 0, FAR, rows - last), np.where(nxt > h, FAR, nxt - rows))
    down = np.where(near >= FAR, FAR, near**2)
    # Along each row the lower envelope of the parabolas that stand on its columns, one for each column: linear in the pixels.
    out = np.empty((h, w))
    at = np.arange(w, dtype=np.float64)
    for y in range(h):
        feet = np.flatnonzero(down[y] < FAR)
        if not len(feet):
            out[y] = FAR
            continue
        base = down[y, feet]
        hull, starts = [0], [-np.inf]
        for k in range(1, len(feet)):
            while True:
                j = hull[-1]
                meet = (base[k] + float(feet[k]) ** 2 - base[j] - float(feet[j]) ** 2) / (2.0 * (feet[k] - feet[j]))
                if meet > starts[-1]:
                    break
                hull.pop(), starts.pop()
            hull.append(k), starts.append(meet)
        best = np.array(hull)[np.searchsorted(starts, at, side="right") - 1]
        out[y] = (at - feet[best]) ** 2 + base[best]
    return out


def skeleton(mask: np.ndarray, most: int = 200) -> np.ndarray:
    """Zhang-Suen thinning."""
    m = np.pad(mask, 1).astype(np.uint8)
    for _ in range(most):
        changed = False
        for second in (False, True):
            n = [m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            held = sum(a.astype(np.int8) for a in n)
            rises = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            up, right, low, left = n[0], n[2], n[4], n[6]
            gate = (up * right * left == 0) & (up * low * left == 0) if second else (up * right * low == 0) & (right * low * left == 0)
            gone = (m[1:-1, 1:-1] == 1) & (held >= 2) & (held <= 6) & (rises == 1) & gate
            if gone.any():
                m[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            break
    return m[1:-1, 1:-1].astype(bool)


def branches(skel: np.ndarray) -> list[dict]:
    """Paths of the skeleton between pixels that don't have two neighbours, then closed ones; points at pixel centres.

    Diagonal neighbours count only where no orthogonal pixel joins the two already.
    """
    pixels = {(int(x), int(y)) for y, x in np.argwhere(skel)}

    def around(p: tuple[int, int]) -> list[tuple[int, int]]:
        x, y = p
        out = [(x + dx, y + dy) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)) if (x + dx, y + dy) in pixels]
        for dx, dy in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
            if (x + dx, y + dy) in pixels and (x + dx, y) not in pixels and (x, y + dy) not in pixels:
                out.append((x + dx, y + dy))
        return out

    order = sorted(pixels, key=lambda p: (p[1], p[0]))
    near = {p: around(p) for p in order}
    done: set[frozenset] = set()
    seen: set[tuple[int, int]] = set()
    out = []

    def make(path: list, closed: bool) -> None:
        pts = np.array(path, float) + 0.5
        ends = [1 if closed else len(near[path[0]]), 1 if closed else len(near[path[-1]])]
        out.append({"points": pts, "closed": closed, "ends": ends, "free": 0 if closed else sum(e <= 1 for e in ends), "length": fit.path_length(pts, closed)})

    for p in order:
        if len(near[p]) == 2:
            continue
        seen.add(p)
        if not near[p]:
            make([p], False)
        for q in near[p]:
            if frozenset((p, q)) in done:
                continue
            path, before, at = [p], p, q
            done.add(frozenset((p, q)))
            while True:
                path.append(at)
                seen.add(at)
                if len(near[at]) != 2:
                    break
                nxt = near[at][0] if near[at][1] == before else near[at][1]
                if frozenset((at, nxt)) in done:
                    break
                done.add(frozenset((at, nxt)))
                before, at = at, nxt
            make(path, False)
    for p in order:
        if p in seen or len(near[p]) != 2:
            continue
        path, before, at = [p], p, near[p][0]
        seen.add(p)
        while at != p and at not in seen:
            path.append(at)
            seen.add(at)
            before, at = at, near[at][0] if near[at][1] == before else near[at][1]
        make(path, True)
    return out


def without_spurs(found: list[dict], width: float, factor: float = SPUR) -> list[dict]:
    return [b for b in found if b["closed"] or b["length"] >= max(1.5, factor * width) or b["free"] != 1]


def stroke_width(pixels: int, length: float, free: int, radius: float, guess: float) -> float:
    """Pixels over length, the skeleton's ends being half a width short of the stroke's; two passes."""
    w = guess
    for _ in range(2):
        reach = length + free * w / 2
        if reach <= 0:
            return guess
        w = min(2 * radius + 1, max(0.5, pixels / reach))
    return w


def centreline(mask: np.ndarray, pixels: int, elongation: float, detail: float, smoothing: float) -> list[dict] | None:
    """Strokes (path, closed, width) of a region's mask with a margin of a pixel, or None where it isn't a thin stroke."""
    if pixels < LEAST_PIXELS:
        return None
    field = distance_squared(mask)
    radius = math.sqrt(float(field[mask].max()))
    if not 0 < radius <= MOST_RADIUS or pixels / (4 * radius * radius) < elongation:
        return None
    skel = skeleton(mask)
    on = np.sort(np.sqrt(field[skel]))
    if not len(on):
        return None
    rough = max(0.5, 2 * float(on[len(on) // 2]) - 1)
    kept = without_spurs(branches(skel), rough)
    eps, tol = fit.epsilon(detail), fit.tolerance(detail)
    out = []
    for b in kept:
        p = b["points"]
        if len(p) < 2:
            continue
        path = fit.fit_chain(p, b["closed"], detail, smoothing)
        if path and path[1]:
            out.append({"path": path, "closed": b["closed"], "free": b["free"]})
    if not out:
        return None
    length = sum(fit.curve_length(s["path"]) for s in out)
    width = stroke_width(pixels, length, sum(s["free"] for s in out), radius, rough)
    return [{"path": s["path"], "closed": s["closed"], "width": width} for s in out]
