"""Hulls against brute force; simplified borders stay shared and never cross."""

import itertools
import math
import random

import pytest

from terrafold.operators import generalize as Z

RINGS = "id long, rings array<array<struct<x:double,y:double>>>"


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def brute_hull(points):
    """Corners: points with all others on one side of the way to the next corner, and none beyond in line."""
    points = sorted(set(points))
    out = set()
    for a, b in itertools.permutations(points, 2):
        side = [cross(a, b, p) for p in points]
        if min(side) >= 0 and not any(s == 0 and not (min(a, b) <= p <= max(a, b)) for s, p in zip(side, points, strict=True)):
            out |= {a, b}
    return out or set(points)


def test_hulls(spark):
    r = random.Random(3)
    sets = {k: [(float(r.randint(0, m)), float(r.randint(0, m))) for _ in range(n)] for k, (m, n) in enumerate([(3, 40), (20, 60), (1000, 50), (2, 3), (5, 1)])}
    sets[7] = [(float(k % 5), float(k % 5) * 2) for k in range(20)]
    sets[None] = [(0.0, 0.0), (4.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    rows = [(k, *p) for k, ps in sets.items() for p in ps] + [(1, None, 2.0), (1, float("nan"), 2.0), (9, None, None)]
    got = {h.id: [(p.x, p.y) for p in h.ring] for h in Z.hulls(spark.createDataFrame(rows, "id long, x double, y double").repartition(5), "id").collect()}
    assert got.keys() == sets.keys()
    for k, ring in got.items():
        want = brute_hull(sets[k])
        assert set(ring) == want, k
        if len(want) > 2:
            assert ring[0] == ring[-1] == min(want) and len(ring) == len(want) + 1
            assert all(cross(a, b, c) > 0 for a, b, c in zip(ring, ring[1:], ring[2:], strict=False))


def meets(a, b, c, d):
    """Segments that meet other than in a common end."""
    if {a, b} & {c, d}:
        return {a, b} == {c, d}
    return cross(a, b, c) * cross(a, b, d) <= 0 and cross(c, d, a) * cross(c, d, b) <= 0 and max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))


@pytest.fixture(scope="module")
def patchwork():
    """Four cells around one point with wavy common borders, an island in a narrow bay, and a lone ring."""
    r = random.Random(2)

    def wave(a, b, n=40, amp=0.8):
        return [(a[0] + (b[0] - a[0]) * k / n + (r.uniform(-amp, amp) if 0 < k < n else 0), a[1] + (b[1] - a[1]) * k / n + (r.uniform(-amp, amp) if 0 < k < n else 0)) for k in range(n + 1)]

    corner = {(i, j): (i * 50.0, j * 50.0) for i in range(3) for j in range(3)}
    side = {}
    for i, j in corner:
        for di, dj in ((1, 0), (0, 1)):
            if (i + di, j + dj) in corner:
                side[(i, j), (i + di, j + dj)] = sorted_wave = wave(corner[i, j], corner[i + di, j + dj])
                side[(i + di, j + dj), (i, j)] = sorted_wave[::-1]
    shapes = {}
    for i, j in itertools.product(range(2), repeat=2):
        way = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
        shapes[i * 2 + j] = [[p for a, b in zip(way, way[1:], strict=False) for p in side[a, b][:-1]]]
    bay = [(200.0, 0.0), (240.0, 0.0), (240.0, 20.0), *((240.0 - k, 20.0 + 1.5 * math.sin(k)) for k in range(1, 40)), (200.0, 20.0)]
    shapes[10] = [bay]
    shapes[11] = [[(216.4 + math.cos(t), 21.35 + 0.2 * math.sin(t)) for t in (k * math.pi / 8 for k in range(16))]]
    shapes[12] = [[(300 + 10 * math.cos(k / 20 * math.pi), 10 * math.sin(k / 20 * math.pi)) for k in range(40)], []]
    return shapes


def test_simplified(spark, patchwork):
    df = spark.createDataFrame([*patchwork.items(), (20, None), (21, [])], RINGS)
    tolerance = 2.0
    got = {s.id: [[(p.x, p.y) for p in r] for r in s.rings] for s in Z.simplified(df, "id", tolerance, 20.0).collect()}
    assert got.keys() == patchwork.keys()
    before, after = sum(len(s[0]) for s in patchwork.values()), sum(len(s[0]) for s in got.values())
    assert after < before / 3
    segments = {}
    for k, rings in got.items():
        for ring in rings:
            assert ring[0] == ring[-1] and set(ring) <= set(patchwork[k][0])
            for a, b in zip(ring, ring[1:], strict=False):
                segments.setdefault((min(a, b), max(a, b)), set()).add(k)
    old = {frozenset(e): k for k, s in patchwork.items() for e in zip(s[0], s[0][1:] + s[0][:1], strict=True)}
    shared = {e for e in segments if len(segments[e]) == 2}
    assert shared and old
    for e, f in itertools.combinations(segments, 2):
        assert not meets(*e, *f), (e, f)
    for i, j in itertools.product(range(2), repeat=2):  # inner borders belong to two cells: no gaps
        for a, b in zip(got[i * 2 + j][0], got[i * 2 + j][0][1:], strict=False):
            inner = all(5 < p[0] < 95 and 5 < p[1] < 95 for p in (a, b))
            assert not inner or (min(a, b), max(a, b)) in shared
    for k, s in patchwork.items():
        for p in s[0]:
            assert min(gap(p, a, b) for a, b in zip(got[k][0], got[k][0][1:], strict=False)) <= tolerance + 1e-9


def gap(p, a, b):
    d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0
    return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))


def test_query_outlines(spark):
    circle = lambda n, r: [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    noise = random.Random(1)
    jagged = [(x * noise.uniform(5, 90), y * noise.uniform(5, 90)) for x, y in circle(400, 1)]
    rows = [(1, [circle(8, 1.0)]), (2, [circle(500, 3.0)]), (3, [circle(30, 2.0), circle(10, 1.0)]), (4, [jagged]), (5, None), (6, [[(1.0, 1.0), (1.0, 1.0)]])]
    got = {o.id: [(p.x, p.y) for p in o.ring] for o in Z.query_outlines(spark.createDataFrame(rows, RINGS), "id").collect()}
    assert got.keys() == {1, 2, 3, 4, 6} and all(len(r) <= 50 and r[0] == r[-1] for r in got.values())
    assert len(got[1]) == 9 and 8 < len(got[2]) <= 50 and len(got[3]) == 31 and len(got[4]) == 5
    assert max(abs(x) for x, _ in got[4]) == max(abs(x) for x, _ in jagged)


def test_preview(spark):
    square = [[(0.0, 0.0), (900.0, 0.0), (900.4, 450.0), (900.0, 900.0), (0.0, 900.0), (0.0, 0.0)]]
    many = {f"c{k:02}": "v" * 300 for k in range(20)}
    rows = [("a", k, None if k == 5 else square, many) for k in range(9)] + [("b", k, square, None) for k in range(20)]
    df = spark.createDataFrame(rows, "source_file string, feature_no long, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>")
    got = Z.preview(df, most=12).collect()
    assert sorted((p.source_file, p.feature_no) for p in got) == [("a", k) for k in range(5)] + [("b", k) for k in range(12)]
    one = next(p for p in got if p.source_file == "a")
    assert len(one.properties) == 12 and {len(v) for v in one.properties.values()} == {180} and len(one.rings[0]) == 5
