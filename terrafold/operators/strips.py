"""Covered trapezoids of many small overlays at once, as array work in one task.

A cell (a tile of a group) holds sides of shapes. A shape none of whose sides runs through a cell covers all of it or
nothing: what covers all hides the other shapes of its side of the overlay, so a dense cell that is split in four is
soon empty of sides. Cells with few sides are divided at all vertices and crossings, as ``overlay`` tells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Heights and crossings are multiples of this (a power of two: exact for coordinates below 8 million).
GRID = 2.0**-30
#: Rows that are worked on at once.
AT_ONCE = 1 << 20


def snapped(v: np.ndarray) -> np.ndarray:
    """The nearest multiple of GRID."""
    return np.floor(v / GRID + 0.5) * GRID


@dataclass
class Sides:
    """Sides from left to right (x1 <= x2); ``shape`` numbers the shapes, ``of`` tells for each shape which side of the overlay (0 or 1) it is on."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    shape: np.ndarray
    of: np.ndarray

    def height(self, e: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sides' y at x; at their ends exactly that of the ends."""
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        with np.errstate(invalid="ignore", divide="ignore"):
            y = snapped(y1 + (y2 - y1) * ((x - x1) / (x2 - x1)))
        return np.where(x <= x1, y1, np.where(x >= x2, y2, y))

    def meets(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where the sides meet the level line at y between their ends; NaN if they don't."""
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        with np.errstate(invalid="ignore", divide="ignore"):
            x = snapped(x1 + (x2 - x1) * ((y - y1) / (y2 - y1)))
        return np.where((np.minimum(y1, y2) < y) & (y < np.maximum(y1, y2)), x, np.nan)


@dataclass
class Cells:
    """Squares (tx, ty) of ``size`` of the ``group``s; ``cell`` and ``edge`` pair them with the sides that matter there, and ``inner`` tells which sides run through."""

    group: np.ndarray
    size: np.ndarray
    tx: np.ndarray
    ty: np.ndarray
    cell: np.ndarray
    edge: np.ndarray
    inner: np.ndarray

    def taken(self, which: np.ndarray) -> Cells:
        """Those of the cells for which ``which`` is true."""
        number = np.cumsum(which) - 1
        on = which[self.cell]
        return Cells(self.group[which], self.size[which], self.tx[which], self.ty[which], number[self.cell[on]], self.edge[on], self.inner[on])


def _settled(s: Sides, box: tuple[np.ndarray, ...], group: np.ndarray, size: np.ndarray, tx: np.ndarray, ty: np.ndarray, cell: np.ndarray, edge: np.ndarray) -> Cells:
    """The cells with those of the paired sides that matter: sides beside or above a cell and hidden shapes are left out."""
    x0, y0 = (tx * size)[cell], (ty * size)[cell]
    x3, y3 = ((tx + 1) * size)[cell], ((ty + 1) * size)[cell]
    x1, x2, shape = s.x1[edge], s.x2[edge], s.shape[edge]
    near = (box[0][shape] < x3) & (box[2][shape] > x0) & (box[1][shape] < y3) & (box[3][shape] > y0) & (x1 < x3) & (x2 > x0)
    cell, edge, x0, y0, x3, y3, shape = (v[near] for v in (cell, edge, x0, y0, x3, y3, shape))
    upright = s.x1[edge] == s.x2[edge]
    left = np.where(upright, s.y1[edge], s.height(edge, np.maximum(x0, s.x1[edge])))
    right = np.where(upright, s.y2[edge], s.height(edge, np.minimum(x3, s.x2[edge])))
    low, high = np.minimum(left, right), np.maximum(left, right)
    below, inner = high <= y0, (high > y0) & (low < y3)
    # of each shape in a cell: whether a side runs through, and how many are below the middle
    key, at = np.unique(cell * len(s.of) + shape, return_inverse=True)
    middle = (x0 + x3) / 2
    through = np.bincount(at, inner, len(key)) > 0
    odd = np.bincount(at, below & (s.x1[edge] <= middle) & (middle < s.x2[edge]), len(key)) % 2 == 1
    full = ~through & odd
    kept = through | full
    if full.any():
        of = key // len(s.of) * 2 + s.of[key % len(s.of)]  # cell and side of the overlay
        first = np.full(2 * len(size), -1)
        first[of[full][::-1]] = np.flatnonzero(full)[::-1]
        kept = np.where(first[of] >= 0, first[of] == np.arange(len(key)), kept)
    on = kept[at] & (inner | (below & ~upright))
    return Cells(group, size, tx, ty, cell[on], edge[on], inner[on])


def leaves(s: Sides, group: np.ndarray, size: np.ndarray, tx: np.ndarray, ty: np.ndarray, cell: np.ndarray, most: int, splits: int):
    """``Cells`` of few sides each; ``cell`` is that of each side. Cells with more than ``most`` are split in four, up to ``splits`` times."""
    box = (np.full(len(s.of), np.inf), np.full(len(s.of), np.inf), np.full(len(s.of), -np.inf), np.full(len(s.of), -np.inf))
    for b, f, v in ((0, np.minimum, s.x1), (1, np.minimum, np.minimum(s.y1, s.y2)), (2, np.maximum, s.x2), (3, np.maximum, np.maximum(s.y1, s.y2))):
        f.at(box[b], s.shape, v)
    todo = [(0, _settled(s, box, group, size, tx, ty, cell, np.arange(len(s.x1))))]
    while todo:
        level, c = todo.pop()
        many = np.bincount(c.cell, minlength=len(c.size)) > most
        if level == splits or not many.any():
            yield c
            continue
        if not many.all():
            yield c.taken(~many)
        c = c.taken(many)
        n = len(c.size)
        halves = [(c.tx * 2 + i, c.ty * 2 + j) for i in (0, 1) for j in (0, 1)]
        if len(c.cell) <= AT_ONCE:
            halves = [tuple(np.concatenate(v) for v in zip(*halves, strict=True))]
        for x, y in halves:
            k = len(x) // n
            todo.append((level + 1, _settled(s, box, np.tile(c.group, k), np.tile(c.size / 2, k), x, y, np.concatenate([c.cell + i * n for i in range(k)]), np.tile(c.edge, k))))


def _crossings(s: Sides, c: Cells, x: np.ndarray, to: np.ndarray):
    """(cell, x) where two sides that run through a cell cross in it; x and to: their range in the cell."""
    through = np.flatnonzero(c.inner & (x < to))
    e = c.edge[through]
    # equal sides cross the same others
    by = np.lexsort((s.y2[e], s.x2[e], s.y1[e], s.x1[e], x[through], c.cell[through]))
    e, cell, at, end = e[by], c.cell[through][by], x[through][by], to[through][by]
    if not len(e):
        return
    new = np.append(True, np.any([v[1:] != v[:-1] for v in (cell, s.x1[e], s.y1[e], s.x2[e], s.y2[e])], axis=0))
    e, cell, at, end = (v[new] for v in (e, cell, at, end))
    # rows are in the order of cell and x: each meets those after it that begin before it ends
    wide = 2 * float(c.size.max())
    place = cell * wide + (at - (c.tx * c.size)[cell])
    last = np.searchsorted(place, cell * wide + (end - (c.tx * c.size)[cell]) + wide * 1e-9 + np.abs(place) * 1e-15, side="right")
    many = np.maximum(last - np.arange(len(e)) - 1, 0)
    upto = np.append(0, np.cumsum(many))
    a = 0
    while a < len(e):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(a, z), many[a:z])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:z] - upto[a], many[a:z])
        a = z
        same = cell[i] == cell[j]
        i, j = i[same], j[same]
        p, q = e[i], e[j]
        with np.errstate(invalid="ignore", divide="ignore"):
            slope, other = (s.y2[p] - s.y1[p]) / (s.x2[p] - s.x1[p]), (s.y2[q] - s.y1[q]) / (s.x2[q] - s.x1[q])
            cross = snapped(s.x1[p] + (s.y1[q] - s.y1[p] - other * (s.x1[q] - s.x1[p])) / (slope - other))
        ok = (cross > np.maximum(at[i], at[j])) & (cross < np.minimum(end[i], end[j]))
        yield cell[i][ok], cross[ok]


def strips(s: Sides, c: Cells, rule):
    """(cell, xa, xb, bl, br, low, tl, tr, high) of the trapezoids that the rule covers, some at a time; low and high are sides, -1 for a cell's upper end."""
    flat = s.x1[c.edge] < s.x2[c.edge]
    c = Cells(c.group, c.size, c.tx, c.ty, c.cell[flat], c.edge[flat], c.inner[flat])
    if not len(c.cell):
        return
    x0, y0 = (c.tx * c.size)[c.cell], (c.ty * c.size)[c.cell]
    x3, y3 = ((c.tx + 1) * c.size)[c.cell], ((c.ty + 1) * c.size)[c.cell]
    x, to = np.maximum(s.x1[c.edge], x0), np.minimum(s.x2[c.edge], x3)
    # where sides leave the cell through its lower or upper end
    down, up = s.meets(c.edge, y0), s.meets(c.edge, y3)
    cells, xs = [c.cell, c.cell], [x, to]
    for at in (down, up):
        ok = c.inner & (at > x) & (at < to)
        cells.append(c.cell[ok])
        xs.append(at[ok])
    for cell, at in _crossings(s, c, x, to):
        cells.append(cell)
        xs.append(at)
    cell, at = np.concatenate(cells), np.concatenate(xs)
    by = np.lexsort((at, cell))
    cell, at = cell[by], at[by]
    new = np.append(True, (cell[1:] != cell[:-1]) | (at[1:] != at[:-1]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    cell, at, n = cell[new], at[new], len(c.cell)
    begin, end = rank[:n], rank[n : 2 * n]
    held = np.cumsum(np.bincount(begin, minlength=len(at)) - np.bincount(end, minlength=len(at)))  # sides over each stretch
    upto = np.append(0, np.cumsum(held))
    a = 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, side="right")) - 1)
        on = np.flatnonzero((begin < z) & (end > a))
        first, many = np.maximum(begin[on], a), np.minimum(end[on], z) - np.maximum(begin[on], a)
        row = np.repeat(on, many)
        stretch = np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        a = z
        if not len(row):
            continue
        xa, xb, e = at[stretch], at[stretch + 1], c.edge[row]
        ends = []
        for v in (xa, xb):
            h = np.clip(s.height(e, v), y0[row], y3[row])
            ends.append(np.where(v == down[row], y0[row], np.where(v == up[row], y3[row], h)))
        yl, yr = ends
        mid, shape = yl + yr, s.shape[e]
        by = np.lexsort((e, mid, shape, stretch))
        own = np.append(True, (stretch[by][1:] != stretch[by][:-1]) | (shape[by][1:] != shape[by][:-1]))
        start = np.maximum.accumulate(np.where(own, np.arange(len(by)), 0))
        sign = np.empty(len(by), np.int64)
        sign[by] = 1 - 2 * ((np.arange(len(by)) - start) % 2)
        # where one shape ends and another begins at one height, the second is entered first: they touch
        by = np.lexsort((e, shape, -sign, mid, stretch))
        stretch, sign, of, yl, yr, e, row, xa, xb = (v[by] for v in (stretch, sign, s.of[shape], yl, yr, e, row, xa, xb))
        fresh = np.append(True, stretch[1:] != stretch[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
        counts = []
        for side in (0, 1):
            step = np.where(of == side, sign, 0)
            run = np.cumsum(step)
            run -= (run - step)[start]
            counts.append((run, run - step))
        (p, p0), (q, q0) = counts
        now, was = rule(p, q), rule(p0, q0)
        turn = np.flatnonzero(now != was)
        follows = np.append(stretch[turn][1:] == stretch[turn][:-1], False)
        here = now[turn]
        lower, upper = turn[here], np.append(turn[1:], 0)[here]
        top = ~follows[here]  # covered up to the cell's upper end
        tl, tr = (np.where(top, y3[row[lower]], v[upper]) for v in (yl, yr))
        ok = (yl[lower] != tl) | (yr[lower] != tr)
        lower, upper = lower[ok], upper[ok]
        yield c.cell[row[lower]], xa[lower], xb[lower], yl[lower], yr[lower], e[lower], tl[ok], tr[ok], np.where(top[ok], -1, e[upper])


def _left_over(group: np.ndarray, line: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, line, at, step): what remains of the steps at each place of a line."""
    by = np.lexsort((at, line, group))
    group, line, at, step = (v[by] for v in (group, line, at, step))
    new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (line[1:] != line[:-1]) | (at[1:] != at[:-1])))[: len(by)]
    step = np.add.reduceat(step, new) if len(new) else step
    on = step != 0
    return group[new][on], line[new][on], at[new][on], step[on]


def _runs(group: np.ndarray, line: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, line, from, to): segments of lines on which the steps so far do not cancel; those below zero run backwards."""
    run = np.cumsum(step)  # each line's steps add up to 0
    k = np.repeat(np.arange(len(run)), np.abs(run))
    ahead = run[k] > 0
    return group[k], line[k], np.where(ahead, at[k], at[np.minimum(k + 1, len(run) - 1)]), np.where(ahead, at[np.minimum(k + 1, len(run) - 1)], at[k])


def outlines(group: np.ndarray, found: tuple[np.ndarray, ...], lower: np.ndarray, upper: np.ndarray, tile: tuple[np.ndarray, ...]):
    """The segments (group, ax, ay, bx, by) around trapezoids with the inside on the left, and the steps (group, line, at, step) on level and on upright ends of tiles.

    ``found``: (xa, xb, bl, br, low, tl, tr, high) as ``strips`` tells them; lower and upper: where their cells end. ``tile``:
    (x0, y0, x3, y3) of each group; what lies on its ends is settled with the tiles beside it."""
    xa, xb, bl, br, low, tl, tr, high = found
    two = lambda a, b: np.concatenate([a, b])
    g, x, to, ya, yb, edge, role = two(group, group), two(xa, xa), two(xb, xb), two(bl, tl), two(br, tr), two(low, high), np.repeat([1, -1], len(xa))
    border = (ya == yb) & ((ya == two(lower, lower)) | (ya == two(upper, upper)))
    level = _left_over(two(g[border], g[border]), two(ya[border], ya[border]), two(x[border], to[border]), two(role[border], -role[border]))
    ones = np.ones(len(xa), np.int64)
    upright = _left_over(np.tile(group, 4), np.concatenate([xb, xb, xa, xa]), np.concatenate([br, tr, bl, tl]), np.concatenate([ones, -ones, -ones, ones]))
    # pieces of one side that follow one another are one segment
    free = np.flatnonzero(~border)
    free = free[np.lexsort((x[free], role[free], edge[free]))]
    g, x, to, ya, yb, edge, role = (v[free] for v in (g, x, to, ya, yb, edge, role))
    new = np.append(True, (edge[1:] != edge[:-1]) | (role[1:] != role[:-1]) | (x[1:] != to[:-1]) | (ya[1:] != yb[:-1]))[: len(free)]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(free))[: len(start)] - 1
    ahead = role[start] == 1
    ax, ay, bx, by = (np.where(ahead, a, b) for a, b in ((x[start], to[end]), (ya[start], yb[end]), (to[end], x[start]), (yb[end], ya[start])))
    parts, ends = [(g[start], ax, ay, bx, by)], []
    for steps, a, b in ((level, 1, 3), (upright, 0, 2)):
        on_end = (steps[1] == tile[a][steps[0]]) | (steps[1] == tile[b][steps[0]])
        ends.append(tuple(v[on_end] for v in steps))
        k, line, at, until = _runs(*(v[~on_end] for v in steps))
        parts.append((k, at, line, until, line) if steps is level else (k, line, at, line, until))
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True)), *ends


def paths(group: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, tile: tuple[np.ndarray, ...]):
    """(group, closed, points from, x, y): segments joined end to start, up to the ends of their tiles; x and y of all points one after another.

    Where several meet, a path turns to the nearest one clockwise of the way back, as the rings of ``overlay`` do."""
    n = len(group)
    inner = lambda x, y: (x != tile[0][group]) & (x != tile[2][group]) & (y != tile[1][group]) & (y != tile[3][group])
    outs, ins = np.flatnonzero(inner(ax, ay)), np.flatnonzero(inner(bx, by))
    out_angle, in_angle = np.arctan2(by - ay, bx - ax), np.arctan2(ay - by, ax - bx)
    outs = outs[np.lexsort((outs, out_angle[outs], ay[outs], ax[outs], group[outs]))]
    ins = ins[np.lexsort((ins, in_angle[ins], by[ins], bx[ins], group[ins]))]
    follow, before = np.full(n, -1), np.full(n, -1)
    if len(outs) and len(ins):
        assert len(outs) == len(ins) and np.array_equal(ax[outs], bx[ins]) and np.array_equal(ay[outs], by[ins]), "an outline does not close"
        new = np.append(True, (group[outs][1:] != group[outs][:-1]) | (ax[outs][1:] != ax[outs][:-1]) | (ay[outs][1:] != ay[outs][:-1]))
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(outs)))
        first, many = np.repeat(start, many), np.repeat(many, many)
        rank = np.arange(len(outs)) - first
        turned = out_angle[outs[first]] > in_angle[ins[first]]
        follow[ins] = outs[first + np.where(turned, (rank - 1) % many, rank)]
        before[follow[ins]] = ins
    order: list[int] = []
    begin: list[int] = []
    ahead, left = follow.tolist(), np.ones(n, bool).tolist()
    for heads in (np.flatnonzero(before < 0).tolist(), range(n)):
        for i in heads:
            if left[i]:
                begin.append(len(order))
                while i >= 0 and left[i]:
                    left[i] = False
                    order.append(i)
                    i = ahead[i]
    walk, begin_at = np.array(order, np.int64), np.array(begin, np.int64)
    closed = before[walk[begin_at]] >= 0
    last = walk[np.append(begin_at[1:], n)[: len(begin_at)] - 1]
    at = np.append(begin_at[1:], n)[: len(begin_at)][~closed]  # open paths have their end too
    x, y = np.insert(ax[walk], at, bx[last[~closed]]), np.insert(ay[walk], at, by[last[~closed]])
    return group[walk[begin_at]], closed, begin_at + np.cumsum(~closed) - ~closed, x, y
