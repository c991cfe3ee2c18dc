"""Dual-tree search over points of the plane (numpy)."""

from __future__ import annotations

import numpy as np

LEAF = 24


class Tree:
    """Balanced binary tree of bounding boxes over points; node n's points are ``order[lo[n]:hi[n]]``."""

    def __init__(self, xy: np.ndarray):
        n = len(xy)
        self.order = np.arange(n)
        lo, hi, left = [0], [n], [-1]
        k = 0
        while k < len(lo):
            a, b = lo[k], hi[k]
            if b - a > LEAF:
                part = self.order[a:b]
                p = xy[part]
                axis = int(np.argmax(np.ptp(p, axis=0)))
                mid = (b - a) // 2
                self.order[a:b] = part[np.argpartition(p[:, axis], mid)]
                left[k] = len(lo)
                lo += [a, a + mid]
                hi += [a + mid, b]
                left += [-1, -1]
            k += 1
        self.lo, self.hi, self.left = np.array(lo), np.array(hi), np.array(left)
        s = xy[self.order]
        self.low = np.array([s[a:b].min(0) for a, b in zip(lo, hi)])
        self.high = np.array([s[a:b].max(0) for a, b in zip(lo, hi)])


def _product(a0, a1, b0, b1):
    """All (i, j) with i in [a0, a1) and j in [b0, b1), over many ranges at once."""
    na, nb = a1 - a0, b1 - b0
    size = na * nb
    k = np.repeat(np.arange(len(size)), size)
    t = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
    return a0[k] + t // nb[k], b0[k] + t % nb[k]


def dual_tree_pairs(a: np.ndarray, b: np.ndarray, radius: float, block: int = 2_000_000):
    """Yields index arrays (i, j) of all a[i], b[j] at most ``radius`` apart (0 included).

    Node pairs further apart than the radius are discarded, node pairs whose furthest points are within it are
    accepted whole, the others are split; pairs of leaves are refined point by point.
    """
    if not len(a) or not len(b):
        return
    ta, tb = Tree(a), Tree(b)
    pa, pb = a[ta.order], b[tb.order]
    r2 = radius * radius
    na, nb = np.zeros(1, int), np.zeros(1, int)

    def emit(x, y, exact):
        size = np.cumsum((ta.hi[x] - ta.lo[x]) * (tb.hi[y] - tb.lo[y]))
        start = 0
        while start < len(x):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + block, "right")))
            i, j = _product(ta.lo[x[start:stop]], ta.hi[x[start:stop]], tb.lo[y[start:stop]], tb.hi[y[start:stop]])
            if exact:
                d = pa[i] - pb[j]
                keep = (d * d).sum(1) <= r2
                i, j = i[keep], j[keep]
            if len(i):
                yield ta.order[i], tb.order[j]
            start = stop

    while len(na):
        gap = np.maximum(0, np.maximum(ta.low[na] - tb.high[nb], tb.low[nb] - ta.high[na]))
        keep = (gap * gap).sum(1) <= r2
        na, nb = na[keep], nb[keep]
        far = np.maximum(ta.high[na] - tb.low[nb], tb.high[nb] - ta.low[na])
        sure = (far * far).sum(1) <= r2
        yield from emit(na[sure], nb[sure], False)
        na, nb = na[~sure], nb[~sure]
        la, lb = ta.left[na], tb.left[nb]
        leaves = (la < 0) & (lb < 0)
        yield from emit(na[leaves], nb[leaves], True)
        na, nb, la, lb = na[~leaves], nb[~leaves], la[~leaves], lb[~leaves]
        split_a = (la >= 0) & ((lb < 0) | (ta.hi[na] - ta.lo[na] >= tb.hi[nb] - tb.lo[nb]))
        na, nb = (
            np.concatenate([la[split_a], la[split_a] + 1, na[~split_a], na[~split_a]]),
            np.concatenate([nb[split_a], nb[split_a], lb[~split_a], lb[~split_a] + 1]),
        )


def edges(xs, ys):
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    return x, y, np.roll(x, -1), np.roll(y, -1)


def in_polygon(px, py, xs, ys):
    """Whether points lie in a polygon (even-odd rule, the boundary included)."""
    x1, y1, x2, y2 = edges(xs, ys)
    px, py = np.asarray(px, float)[:, None], np.asarray(py, float)[:, None]
    spans = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = spans & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    on = (cross == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    return (crosses.sum(1) % 2 == 1) | on.any(1)


def cover(xs, ys, cell: float):
    """Nodes (level, ix, iy, edges) of a quadtree that a polygon touches; a node at level k is 2**k cells wide. Nodes wholly
    inside have no edges; others are cells, with (x1, y1, x2, y2) of the edges that a ray from a point in them to the right
    may meet.

    Descends from the nodes over the bounding box; a node that no edge touches is wholly inside or wholly outside.
    """
    x1, y1, x2, y2 = edges(xs, ys)
    level = 0
    at = lambda v, k: int(np.floor(v / (cell * 2.0**k)))
    while at(x1.max(), level) - at(x1.min(), level) > 1 or at(y1.max(), level) - at(y1.min(), level) > 1:
        level += 1
    todo = [(level, ix, iy) for ix in range(at(x1.min(), level), at(x1.max(), level) + 1) for iy in range(at(y1.min(), level), at(y1.max(), level) + 1)]
    left, right, low, high = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    margin = 1e-9 * max(1.0, float(np.abs(x1).max()))
    while todo:
        level, ix, iy = todo.pop()
        s = cell * 2.0**level
        lx, ly, hx, hy = ix * s, iy * s, (ix + 1) * s, (iy + 1) * s
        # rounding may put a point a little outside of its cell
        near = (right >= lx - margin) & (left <= hx + margin) & (high >= ly - margin) & (low <= hy + margin)
        if near.any():
            # an edge passes the node unless all four corners are clearly on one side of its line
            side_of = np.stack([(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (lx, hx) for cy in (ly, hy)])
            slack = margin * (np.abs(x2 - x1) + np.abs(y2 - y1))
            near &= ~((side_of > slack).all(0) | (side_of < -slack).all(0))
        if near.any():
            if level == 0:
                ray = (high >= ly - margin) & (low <= hy + margin) & (right >= lx - margin)
                yield level, ix, iy, (x1[ray], y1[ray], x2[ray], y2[ray])
            else:
                todo += [(level - 1, 2 * ix + i, 2 * iy + j) for i in (0, 1) for j in (0, 1)]
        elif in_polygon([(lx + hx) / 2], [(ly + hy) / 2], xs, ys)[0]:
            yield level, ix, iy, None
