"""Overlay of polygons against a plain scan of many lines and points."""

import collections
import math
import random

import pytest

from terrafold.operators import overlay

SHAPES = "k string, gid long, side int, rings array<array<struct<x:double,y:double>>>"
BOX = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def moved(ring, dx=0.0, dy=0.0, scale=1.0):
    return [(x * scale + dx, y * scale + dy) for x, y in ring]


def inside(rings, x, y):
    """Even-odd rule over all rings."""
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPES)


def rings_by_key(df, keys=("k",)):
    out = collections.defaultdict(list)
    for r in df.collect():
        ring = [(p.x, p.y) for p in r.ring]
        assert ring[0] == ring[-1] and all(p != q for p, q in zip(ring, ring[1:], strict=False))
        assert all(p != q for p, q in zip(ring, ring[2:], strict=False)), "goes back on itself"
        assert (r.area < 0) == r.hole
        out[tuple(r[k] for k in keys)].append(ring[:-1])
    return out


@pytest.fixture(scope="module")
def crowd():
    """Random triangles, holed boxes, bow-ties and stars of two keys, with repeats, odd shapes and touching boxes."""
    r = random.Random(7)
    rows = []
    for g in range(60):
        x, y = r.uniform(0, 60), r.uniform(0, 40)
        star = [(x + s * math.cos(a), y + s * math.sin(a)) for a, s in ((k * math.pi / 5, (6, 2)[k % 2]) for k in range(10))]
        kind = [[[(x + r.uniform(-6, 6), y + r.uniform(-6, 6)) for _ in range(3)]], [moved(BOX, x, y), moved([(1, 1), (3, 2), (1, 3)], x, y)], [moved([(0, 0), (5, 4), (5, 0), (0, 4)], x, y)], [star], [[star[k * 4 % 10] for k in range(5)]]]
        rows.append(("ab"[g % 2], g, g % 3 % 2, kind[g % 5]))
    rows += [(k, g + 100, s, rings) for k, g, s, rings in rows[:5]]
    rows += [("a", 201, 0, [moved(BOX, 70, 0)]), ("a", 202, 0, [moved(BOX, 74, 0)]), ("a", 203, 0, [moved(BOX, 78, 4)]), ("a", 204, 1, [moved(BOX, 71, 1)])]
    return rows + [("a", 301, 0, None), ("a", 302, 0, []), ("a", 303, 0, [[]]), ("a", 304, 0, [[(1.0, 1.0), (2.0, 2.0)]]), ("c", 305, 0, [[(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]])]


@pytest.mark.parametrize(("rule", "tile", "most"), [("union", 64.0, 30), ("intersection", 16.0, 160), ("difference", 100.0, 60), ("exclusive", 40.0, 60)])
def test_rings(spark, crowd, rule, tile, most):
    """The rings hold exactly the points that the rule says, and their areas are those of the trapezoids."""
    df = frame(spark, crowd)
    got = overlay.dissolved(df, ["k"], tile, rule, most=most)
    rings = rings_by_key(got)
    want = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "exclusive": lambda a, b: a != b}[rule]
    r = random.Random(1)
    for key in "ab":
        mine = [(s, g) for k, _, s, g in crowd if k == key and g]
        for _ in range(600):
            x, y = r.uniform(-5, 85), r.uniform(-5, 48)
            a, b = (any(inside([q for q in g if len(q) > 2], x, y) for s, g in mine if s == side) for side in (0, 1))
            assert inside(rings[key,], x, y) == want(a, b), (key, x, y)
    areas = {r.k: r.area for r in overlay.overlay_area(df, ["k"], 33.0, rule, most).collect()}
    assert set(areas) == {"a", "b"} == {k for (k,) in rings}
    for r in got.groupBy("k").agg({"area": "sum"}).collect():
        assert math.isclose(r[1], areas[r.k], rel_tol=1e-7)


def test_touching_and_nested(spark):
    """Boxes side by side become one ring; boxes that touch in a corner stay two; a ring of boxes has a hole."""
    boxes = {"side": [(0, 0), (4, 0)], "corner": [(0, 0), (4, 4)], "frame": [(x, y) for x in (0, 4, 8) for y in (0, 4, 8) if (x, y) != (4, 4)], "same": [(0, 0)] * 5, "across": [(30, 30)]}
    rows = [(k, g, 0, [moved(BOX, *at)]) for k, places in boxes.items() for g, at in enumerate(places)]
    for tile in (1000.0, 8.0, 3.0):
        got = overlay.dissolved(frame(spark, rows), ["k"], tile).collect()
        count = collections.Counter((r.k, r.hole, r.area) for r in got)
        assert count == {("side", False, 32.0): 1, ("corner", False, 16.0): 2, ("frame", False, 144.0): 1, ("frame", True, -16.0): 1, ("same", False, 16.0): 1, ("across", False, 16.0): 1}, tile
        assert {len(r.ring) for r in got} == {5}


def test_repair(spark):
    rows = {1: [BOX], 2: [moved([(0, 0), (4, 4), (4, 0), (0, 4)])], 3: [BOX, moved(BOX, 1, 1, 0.5)], 4: [BOX, moved(BOX, 2, 2)], 5: [BOX, BOX], 6: [moved([(0, 0), (4, 0), (4, 2), (9, 2), (4, 2), (4, 4), (0, 4)])], 7: [BOX, moved(BOX, 1, 1, 0.5), moved(BOX, 1.5, 1.5, 0.25)], 8: None}
    df = spark.createDataFrame(list(rows.items()), "id long, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: (round(r.area, 9), sorted(len(x) for x in r.rings)) for r in overlay.repaired(df, "id", 3.0).collect()}
    assert got == {1: (16, [5]), 2: (8, [4, 4]), 3: (12, [5, 5]), 4: (24, [7, 7]), 6: (16, [5]), 7: (13, [5, 5, 5])}
    assert {r.id: r.crossings for r in overlay.self_crossing(df, "id").collect()} == {2: 1, 4: 2}


def test_shared_and_covered(spark):
    a = spark.createDataFrame([(k, [moved(BOX, 3.0 * k, k)]) for k in range(5)], "a long, rings array<array<struct<x:double,y:double>>>")
    b = spark.createDataFrame([("big", [moved(BOX, -100, -100, 60)]), ("hole", [moved(BOX, 0, 0, 5), moved(BOX, 3, 1)]), ("far", [moved(BOX, 500, 500)]), ("none", None)], "b string, rings array<array<struct<x:double,y:double>>>")
    got = {(r.a, r.b): r.area for r in overlay.shared_area(a, b, 10.0, "a", "b").collect()}
    assert got == {**{(k, "big"): 16 for k in range(5)}, (0, "hole"): 13, (2, "hole"): 13, (3, "hole"): 16, (4, "hole"): 16}
    parts = {(r.a, r.b): r for r in overlay.clipped(a, b, 10.0, "a", "b").collect()}
    assert {k: r.area for k, r in parts.items()} == got and {len(r.rings) for r in parts.values()} <= {1, 2}
    for k in range(5):
        assert sorted((p.x, p.y) for p in parts[k, "big"].rings[0][:-1]) == sorted(moved(BOX, 3.0 * k, k))
    for x, y in ((3.5, 1.5), (2.5, 3.5), (3.5, 4.9), (0.5, 0.5)):
        assert inside([[(p.x, p.y) for p in r[:-1]] for r in parts[0, "hole"].rings], x, y) == (x < 4 and y < 4 and not (x > 3 and 1 < y < 5))
    cover = {r.b: (round(r.percent, 9), round(r.missing_m2, 6)) for r in overlay.coverage(a, b, "b", 7.0).collect()}
    union = 5 * 16 - 4 * 3
    assert cover == {"big": (round(union / 57600 * 100, 9), 57600 - union), "hole": (round((union - 16) / 384 * 100, 9), 384 - union + 16), "far": (0, 16)}


def test_empty(spark):
    df = frame(spark, [])
    assert overlay.dissolved(df, ["k"], 10.0).collect() == [] and overlay.overlay_area(df, ["k"], 10.0).collect() == []
