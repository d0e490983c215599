"""Label maps: connected regions, speck removal, smoothing, backdrop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: left, right, up, down: the order in which neighbours count as seen
SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))


@dataclass
class Regions:
    ids: np.ndarray  # (h, w), numbered by first pixel in scan order
    label: np.ndarray
    area: np.ndarray
    box: np.ndarray  # (n, 4): least x, least y, greatest x, greatest y


def components(labels: np.ndarray) -> Regions:
    """4-connected regions of equal labels, -1 included: union of row runs that touch vertically."""
    h, w = labels.shape
    start = np.ones((h, w), bool)
    start[:, 1:] = labels[:, 1:] != labels[:, :-1]
    run = np.cumsum(start.ravel()).reshape(h, w) - 1
    parent = list(range(int(run[-1, -1]) + 1))
    same = labels[1:] == labels[:-1]
    pairs = np.stack([run[:-1][same], run[1:][same]], axis=1)
    if len(pairs):
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    roots = np.array([find(i) for i in range(len(parent))])
    _, dense = np.unique(roots, return_inverse=True)
    ids = dense[run]
    n = int(dense.max()) + 1
    flat, y, x = ids.ravel(), *np.divmod(np.arange(h * w), w)
    box = np.stack([np.full(n, w), np.full(n, h), np.full(n, -1), np.full(n, -1)], axis=1)
    np.minimum.at(box[:, 0], flat, x), np.minimum.at(box[:, 1], flat, y)
    np.maximum.at(box[:, 2], flat, x), np.maximum.at(box[:, 3], flat, y)
    label = np.empty(n, labels.dtype)
    label[flat] = labels.ravel()
    return Regions(ids, label, np.bincount(flat, minlength=n), box)


def despeckle(labels: np.ndarray, least: int, passes: int = 4) -> tuple[np.ndarray, int]:
    """Dissolve regions under ``least`` pixels into the neighbour label they border longest (ties: seen first).

    -1 is a label like any other. Each pass decides all regions from the labels before it.
    """
    gone = 0
    for _ in range(passes if least > 1 else 0):
        regions = components(labels)
        small = regions.area < least
        if not small.any() or len(small) == 1:
            break
        h, w = labels.shape
        at, order = small[regions.ids], np.arange(h * w).reshape(h, w) * 4
        rows = []
        for side, (dy, dx) in enumerate(SIDES):
            me = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
            you = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
            edge = at[me] & (regions.ids[me] != regions.ids[you])
            rows.append(np.stack([regions.ids[me][edge], labels[you][edge], order[me][edge] + side], axis=1))
        rows = np.concatenate(rows)
        if not len(rows):
            break
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        length = np.diff(np.concatenate((first, [len(rows)])))
        region, label, seen = rows[first].T
        best = np.lexsort((seen, -length, region))
        lead = best[np.concatenate(([True], region[best][1:] != region[best][:-1]))]
        becomes = regions.label.copy()
        becomes[region[lead]] = label[lead]
        labels = becomes[regions.ids]
        gone += len(lead)
    return labels, gone


def smooth(labels: np.ndarray, rounds: int = 1, least: int = 6) -> np.ndarray:
    """Replace a pixel by the label that at least ``least`` of its 8 neighbours share."""
    for _ in range(rounds):
        h, w = labels.shape
        out = labels.copy()
        for k in np.unique(labels):
            mine = np.pad((labels == k).astype(np.int8), 1)
            count = sum(mine[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
            out[(count >= least) & (labels != k)] = k
        if (out == labels).all():
            break
        labels = out
    return labels


def _border(labels: np.ndarray, twice: bool) -> np.ndarray:
    side = slice(None) if twice else slice(1, -1)
    rows = [labels[0], labels[-1]] if labels.shape[0] > 1 or twice else [labels[0]]
    columns = [labels[side, 0], labels[side, -1]] if labels.shape[1] > 1 or twice else [labels[side, 0]]
    return np.concatenate(rows + columns)


def backdrop(labels: np.ndarray, least_border: float = 0.7, least_whole: float = 0.6) -> int | None:
    """The label that covers most of the border and hangs together, if there is one."""
    edge = _border(labels, twice=False)
    counts = np.bincount(edge[edge >= 0]) if (edge >= 0).any() else np.zeros(1, np.int64)
    best = int(counts.argmax())
    if counts[best] == 0 or counts[best] < least_border * len(edge):
        return None
    regions = components(labels)
    areas = regions.area[regions.label == best]
    return best if areas.max() >= least_whole * areas.sum() else None


def border_label(labels: np.ndarray) -> int | None:
    """The commonest label of the border, corners counted with both sides."""
    edge = _border(labels, twice=True)
    edge = edge[edge >= 0]
    return int(np.bincount(edge).argmax()) if len(edge) else None


def remove_backdrop(labels: np.ndarray, label: int) -> np.ndarray:
    """Make those regions of ``label`` transparent that touch the border."""
    regions = components(labels)
    touching = np.unique(_border(regions.ids, twice=True))
    gone = touching[regions.label[touching] == label]
    return np.where(np.isin(regions.ids, gone), -1, labels)
