"""Components and density clusters of one group of cells or points, in numpy, without loops over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

#: Pairs of points that are compared at once.
PAIRS = 2_000_000


def lowest(i: np.ndarray, j: np.ndarray, n: int, low: np.ndarray | None = None) -> np.ndarray:
    """The smallest of ``n`` nodes that each reaches by pairs ``i, j``; ``low`` is what earlier pairs gave."""
    low = np.arange(n) if low is None else low
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return low
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up


class Lattice:
    """Distinct integer cells of two or three dimensions in order, and their neighbours by index."""

    def __init__(self, cells: np.ndarray):
        c = np.asarray(cells, np.int64)
        c = np.column_stack([np.zeros((len(c), 3 - c.shape[1]), np.int64), c])
        c = c - c.min(axis=0) if len(c) else c
        self.rows, self.high = c[:, 1], c[:, 2]
        self.wide, self.deep = (int(x.max()) + 1 if len(c) else 1 for x in (self.rows, self.high))
        # columns of cells first, then heights in them, so that numbers stay small for wide groups
        self.flat = c[:, 0] * self.wide + self.rows
        self.columns, own = np.unique(self.flat, return_inverse=True)
        self.key = own * self.deep + self.high
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]

    def beside(self, step: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Cells that have one at ``step`` from them, and that one."""
        dx, dy, dz = (0,) * (3 - len(step)) + tuple(step)
        row, high = self.rows + dy, self.high + dz
        inside = np.flatnonzero((row >= 0) & (row < self.wide) & (high >= 0) & (high < self.deep))
        flat = self.flat[inside] + dx * self.wide + dy
        to = np.minimum(np.searchsorted(self.columns, flat), len(self.columns) - 1)
        there = self.columns[to] == flat
        inside, key = inside[there], to[there] * self.deep + high[inside[there]]
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        there = self.sorted[at] == key
        return inside[there], self.order[at[there]]


def steps(dims: int, reach: int = 1, full: bool = True) -> list[tuple[int, ...]]:
    """Half of the steps to the cells within ``reach``, to those that share a face only if not ``full``."""
    return [s for s in product(range(-reach, reach + 1), repeat=dims) if s > (0,) * dims and (full or sum(map(abs, s)) == 1)]


def touching(cells: np.ndarray, full: bool = True) -> np.ndarray:
    """For each of some distinct cells, the first cell of its component."""
    low = np.arange(len(cells))
    if len(cells):
        lattice = Lattice(cells)
        for s in steps(cells.shape[1], full=full):
            low = lowest(*lattice.beside(s), len(cells), low)
    return low


def _crossed(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of ranges ``a`` to ``a + an`` and ``b`` to ``b + bn``, some at a time: number of the pair of ranges, and two indices."""
    total = np.cumsum(an * bn)
    at = 0
    while at < len(a):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        for s in range(0, int(an[at]) if to == at + 1 else 1, max(1, PAIRS // max(1, int(bn[at])))):
            x, xn = a[at:to] + s, an[at:to] - s
            if to == at + 1:
                xn = np.minimum(xn, max(1, PAIRS // max(1, int(bn[at]))))
            n = xn * bn[at:to]
            pair = np.repeat(np.arange(to - at), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            yield pair + at, x[pair] + k // bn[at:to][pair], b[at:to][pair] + k % bn[at:to][pair]
        at = to


def density_clusters(xyz: np.ndarray, ids: np.ndarray, eps: float, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in clusters, the smallest core id of each one's cluster, and whether the row is a core point.

    All points of a cell of ``eps / sqrt(dims)`` are within ``eps`` of each other, so a cell of ``min_points`` needs no
    comparison to find its core points, and two cells need one pair within ``eps`` to be connected.
    """
    n, dims = xyz.shape
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, bool)
    cell = np.floor((xyz - xyz.min(axis=0)) / (eps / dims**0.5 * (1 - 1e-9))).astype(np.int64)
    by = np.lexsort(cell.T)
    xyz, ids, cell = xyz[by], ids[by], cell[by]
    first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
    size = np.diff(np.append(first, n))
    own = np.repeat(np.arange(len(first)), size)
    lattice = Lattice(cell[first])
    reach = int(np.ceil(dims**0.5))
    near = [lattice.beside(s) for s in steps(dims, reach) if sum(max(abs(x) - 1, 0) ** 2 for x in s) <= dims]
    a, b = (np.concatenate(x) for x in zip(*near, strict=True))

    def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((xyz[i] - xyz[j]) ** 2).sum(axis=1) <= eps * eps

    core = (size >= min_points)[own]
    count = size[own].copy()
    for x, y in ((a, b), (b, a)):
        few = size[x] < min_points
        x, y = x[few], y[few]
        for _, i, j in _crossed(first[x], size[x], first[y], size[y]):
            np.add.at(count, i[within(i, j)], 1)
    core |= count >= min_points
    # core points lead their cells
    lead = np.lexsort((~core, own))
    xyz, ids, core, by = xyz[lead], ids[lead], core[lead], by[lead]
    cores = np.bincount(own, core, len(first)).astype(np.int64)
    both = (cores[a] > 0) & (cores[b] > 0)
    a2, b2 = a[both], b[both]
    low = np.arange(len(first))
    for most in (4, n):  # a few points of each cell connect most of them
        apart = low[a2] != low[b2]
        a2, b2 = a2[apart], b2[apart]
        for pair, i, j in _crossed(first[a2], np.minimum(cores[a2], most), first[b2], np.minimum(cores[b2], most)):
            hit = np.unique(pair[within(i, j)])
            low = lowest(a2[hit], b2[hit], len(first), low)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, low[own[core]], ids[core])
    name = np.where(core, least[low[own]], np.iinfo(np.int64).max)
    rest = np.where(core, 0, 1).astype(bool)
    here = rest & (cores[own] > 0)
    name[here] = least[low[own[here]]]
    for x, y in ((a, b), (b, a)):
        some = (size[x] > cores[x]) & (cores[y] > 0)
        x, y = x[some], y[some]
        for _, i, j in _crossed(first[x] + cores[x], size[x] - cores[x], first[y], cores[y]):
            hit = within(i, j)
            np.minimum.at(name, i[hit], least[low[own[j[hit]]]])
    found = np.flatnonzero(name != np.iinfo(np.int64).max)
    return by[found], name[found], core[found]
