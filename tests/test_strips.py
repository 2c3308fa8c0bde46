"""Dense overlays in array work against counts of single squares."""

import numpy as np
import pytest

from terrafold.operators import overlay, strips


def boxes(n, wide, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(0, wide - 8, (2, n))
    return x, y, x + r.integers(1, 9, n), y + r.integers(1, 9, n)


def sides_of(x0, y0, x1, y1, of):
    n = len(x0)
    ends = [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
    return strips.Sides(*(np.concatenate([np.asarray(e[k], float) for e in ends]) for k in range(4)), np.tile(np.arange(n), 4), of)


@pytest.mark.parametrize(("n", "most"), [(40, 8), (40, 10_000), (20_000, 16)])
@pytest.mark.parametrize("rule", sorted(overlay.RULES))
def test_boxes(n, most, rule):
    """Areas over cells that are split or not; of many boxes few sides are left, as most lie below boxes that cover all of a cell."""
    wide = 64
    x0, y0, x1, y1 = boxes(n, wide, n)
    of = np.arange(n) % 2 if rule != "union" else np.zeros(n, int)
    s = sides_of(x0, y0, x1, y1, of)
    held = np.zeros((2, wide, wide), bool)
    for k in range(n):
        held[of[k], x0[k] : x1[k], y0[k] : y1[k]] = True
    area, sides = 0.0, 0
    one = (np.arange(1), np.array([64.0]), np.array([0]), np.array([0]), np.zeros(len(s.x1), int))
    for c in strips.leaves(s, *one, most, 12):
        sides += len(c.cell)
        for _, xa, xb, bl, br, _, tl, tr, _ in strips.strips(s, c, overlay.RULES[rule]):
            area += (((tl + tr) - (bl + br)) / 2 * (xb - xa)).sum()
    assert area == overlay.RULES[rule](held[0].astype(int), held[1].astype(int)).sum()
    assert n < 1000 or sides < n  # of four sides each


def test_crowded_tile(spark):
    """Thousands of boxes over one another in one tile, whose crossings alone were more than half a million, give one ring."""
    n = 3000
    x0, y0, x1, y1 = boxes(n, 40, 5)
    ring = lambda k: [(float(a), float(b)) for a, b in ((x0[k], y0[k]), (x1[k], y0[k]), (x1[k], y1[k]), (x0[k], y1[k]))]
    df = spark.createDataFrame([("a", k, 0, [ring(k)]) for k in range(n)], "k string, gid long, side int, rings array<array<struct<x:double,y:double>>>")
    held = np.zeros((40, 40), bool)
    for k in range(n):
        held[x0[k] : x1[k], y0[k] : y1[k]] = True
    pieces = overlay.in_tiles(df, ["k"], 64.0)
    assert overlay.trapezoids(pieces, ["k"], "union").count() < n
    assert overlay.overlay_area(df, ["k"], 64.0).collect()[0].area == held.sum()
    assert sum(r.area for r in overlay.dissolved(df, ["k"], 64.0).collect()) == held.sum()


def test_paths():
    """Outlines of two tiles: rings inside are closed, a ring across their common end is open in each, and corners that touch stay apart."""
    x0, y0, x1, y1 = (np.array(v, float) for v in zip((1, 1, 3, 3), (3, 3, 5, 5), (6, 1, 10, 2), strict=True))
    n = 3
    s = sides_of(np.tile(x0, 2), np.tile(y0, 2), np.tile(x1, 2), np.tile(y1, 2), np.zeros(2 * n, int))
    cells = (np.arange(2), np.array([8.0, 8.0]), np.array([0, 1]), np.array([0, 0]), np.tile(np.arange(2 * n) // n, 4))
    tile = tuple(np.array(v, float) for v in ([0, 8], [0, 0], [8, 16], [8, 8]))
    (c,) = strips.leaves(s, *cells, 64, 12)
    found = [np.concatenate(v) for v in zip(*strips.strips(s, c, overlay.RULES["union"]), strict=True)]
    cell, rest = found[0], tuple(found[1:])
    segments, level, upright = strips.outlines(cell, rest, np.zeros(len(cell)), np.full(len(cell), 8.0), tile)
    group, closed, start, x, y = strips.paths(*segments, tile)
    rings = {(int(g), bool(k), frozenset(zip(x[a:b].tolist(), y[a:b].tolist(), strict=True))) for g, k, a, b in zip(group, closed, start, [*start[1:], len(x)], strict=True)}
    box = lambda k: frozenset((a, b) for a in (x0[k], x1[k]) for b in (y0[k], y1[k]))
    assert rings == {(0, True, box(0)), (0, True, box(1)), (0, False, frozenset({(8, 2), (6, 2), (6, 1), (8, 1)})), (1, False, frozenset({(8, 1), (10, 1), (10, 2), (8, 2)}))}
    assert not len(level[0]) and sorted(zip(*(v.tolist() for v in upright), strict=True)) == [(0, 8.0, 1.0, 1), (0, 8.0, 2.0, -1), (1, 8.0, 1.0, -1), (1, 8.0, 2.0, 1)]
