"""The planar graph of a region map: boundary chains that both sides share, and each region's closed loops of chains."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# east, south, west, north; +1 is a right turn
STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))


@dataclass
class Chain:
    points: list[tuple[int, int]]  # lattice points where the direction changes; a closed chain doesn't repeat its first
    closed: bool
    right: int  # region on the right hand, -1 for none
    left: int
    out_dir: int = 0  # direction of the first and of the last edge
    in_dir: int = 0


@dataclass
class Loop:
    region: int
    chains: list[tuple[int, bool]]  # chain number, whether reversed; the region is on the right hand
    vertices: list[tuple[int, int]] = field(default_factory=list)

    @property
    def area(self) -> float:
        """Positive for outlines, negative for holes; always from the lattice points."""
        return shoelace(self.vertices)

    @property
    def is_hole(self) -> bool:
        return self.area < 0


def shoelace(points) -> float:
    p = np.asarray(points, float)
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


class _Cracks:
    """Which lattice edges separate different cells. Edge (x, y, d) leaves the vertex (x, y) in direction d."""

    def __init__(self, ids: np.ndarray):
        self.h, self.w = ids.shape
        self.cells = np.pad(ids, 1, constant_values=-1)
        c = self.cells
        across = c[:-1, 1:-1] != c[1:, 1:-1]  # (h + 1, w): edge from (x, y) to the east
        down = c[1:-1, :-1] != c[1:-1, 1:]  # (h, w + 1): edge from (x, y) to the south
        self.out = np.zeros((self.h + 1, self.w + 1, 4), bool)
        self.out[:, :-1, 0] = across
        self.out[:, 1:, 2] = across
        self.out[:-1, :, 1] = down
        self.out[1:, :, 3] = down
        self.degree = self.out.sum(axis=2)

    def sides(self, x: int, y: int, d: int) -> tuple[int, int]:
        """Region on the right and on the left of an edge."""
        # cells around vertex (x, y): padded (y, x) north-west, (y, x+1) north-east, (y+1, x) south-west, (y+1, x+1) south-east
        nw, ne, sw, se = self.cells[y, x], self.cells[y, x + 1], self.cells[y + 1, x], self.cells[y + 1, x + 1]
        right, left = ((se, ne), (sw, se), (nw, sw), (ne, nw))[d]
        return int(right), int(left)


def trace(ids: np.ndarray) -> tuple[list[Chain], list[Loop]]:
    """Chains between junctions (in scan order of the junction, then closed ones) and the loops of all regions from 0 up."""
    cracks = _Cracks(ids)
    open_edges = cracks.out.copy()
    node = (cracks.degree > 2)
    chains: list[Chain] = []
    starts: dict[tuple[int, int, int], tuple[int, bool]] = {}

    def walk(x: int, y: int, d: int, closed: bool) -> Chain:
        right, left = cracks.sides(x, y, d)
        first, chain = (x, y), Chain([(x, y)], closed, right, left, d)
        while True:
            open_edges[y, x, d] = False
            x, y = x + STEP[d][0], y + STEP[d][1]
            open_edges[y, x, (d + 2) % 4] = False
            if node[y, x] or (x, y) == first:
                chain.in_dir = d
                if not closed:
                    chain.points.append((x, y))
                return chain
            out = cracks.out[y, x]
            turn = d if out[d] else (d + 1) % 4 if out[(d + 1) % 4] else (d + 3) % 4
            if turn != d:
                chain.points.append((x, y))
            d = turn

    for y, x in np.argwhere(node).tolist():
        for d in range(4):
            if open_edges[y, x, d]:
                chain = walk(x, y, d, False)
                ex, ey = chain.points[-1]
                starts[(x, y, d)] = (len(chains), False)
                starts[(ex, ey, (chain.in_dir + 2) % 4)] = (len(chains), True)
                chains.append(chain)
    # What is left are closed curves; scanning for a vertex whose east edge is open starts each at a corner.
    for y, x in np.argwhere(open_edges[..., 0]).tolist():
        if open_edges[y, x, 0]:
            chains.append(walk(x, y, 0, True))
            pts = chains[-1].points
            if len(pts) > 2 and chains[-1].in_dir == 0:  # the first point lies within a straight run
                del pts[0]

    loops: list[Loop] = []
    used: set[tuple[int, bool]] = set()
    for number, chain in enumerate(chains):
        for reverse in (False, True):
            region = chain.left if reverse else chain.right
            if region < 0 or (number, reverse) in used:
                continue
            refs, vertices, at = [], [], (number, reverse)
            while at not in used:
                used.add(at)
                refs.append(at)
                c = chains[at[0]]
                points = c.points[::-1] if at[1] else c.points
                vertices.extend(points if c.closed else points[:-1])
                if c.closed:
                    break
                x, y = points[-1]
                d = (c.out_dir + 2) % 4 if at[1] else c.in_dir
                at = next(starts[(x, y, t % 4)] for t in (d + 1, d, d + 3) if cracks.out[y, x, t % 4])
            loops.append(Loop(region, refs, _corners(vertices)))
    return chains, loops


def _corners(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the lattice points at which the outline goes straight on."""
    n = len(points)
    return [
        p for i, p in enumerate(points)
        if (p[0] - points[i - 1][0]) * (points[(i + 1) % n][1] - p[1]) != (p[1] - points[i - 1][1]) * (points[(i + 1) % n][0] - p[0])
    ]
