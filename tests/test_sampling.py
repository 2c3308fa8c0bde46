"""Samples against the sequential greedy choice; slivers against a plain merging, with areas kept."""

import math
import random

from terrafold.functions import geometry as G
from terrafold.operators import sampling, slivers

RINGS = "id long, rings array<array<struct<x:double,y:double>>>"


def greedy(points, spacing):
    kept = []
    for k, i, x, y, p in sorted(points, key=lambda r: (r[4], r[1])):
        if all(q[0] != k or math.hypot(q[2] - x, q[3] - y) >= spacing for q in kept):
            kept.append((k, i, x, y, p))
    return kept


def test_spaced(spark):
    r = random.Random(5)
    points = [("ab"[k % 2], f"p{k}", r.uniform(-20, 60), r.uniform(0, 40), r.randint(0, 200)) for k in range(240)]
    points += [("c", f"g{i}_{j}", float(i), float(j), (i * 7 + j * 13) % 5) for i in range(8) for j in range(8)] + [("d", "same1", 1.0, 1.0, 1), ("d", "same2", 1.0, 1.0, 1)]
    df = spark.createDataFrame([*points, ("e", "none", None, 1.0, 1)], "zone string, id string, x double, y double, priority long")
    for spacing in (6.0, 2.0):
        assert {(p.zone, p.id) for p in sampling.spaced(df, "zone", spacing).collect()} == {k[:2] for k in greedy(points, spacing)}


def test_sample_squares(spark):
    triangle, box = [(0.0, 0.0), (300.0, 0.0), (0.0, 300.0)], [(400.0, 0.0), (520.0, 0.0), (520.0, 50.0), (400.0, 50.0)]
    zones = spark.createDataFrame([(1, [triangle]), (2, [box]), (3, None)], RINGS.replace("id", "zone", 1))
    rows = sampling.sample_squares(zones, "zone", 9, 20.0, 50.0, 0.5).collect()
    by = {z: sorted((q for q in rows if q.zone == z), key=lambda q: q.place) for z in (1, 2)}
    assert len(rows) == len(by[1]) + len(by[2]) and len(by[1]) == 9 and 2 <= len(by[2]) <= 5
    for squares in by.values():
        assert [q.place for q in squares] == list(range(1, len(squares) + 1))
        for k, q in enumerate(squares):
            assert all(math.hypot(q.x - o.x, q.y - o.y) >= 50 for o in squares[:k])
    # at least half of a square of the triangle lies in it when its middle does
    assert all(q.x + q.y <= 300 for q in by[1]) and all(400 <= q.x <= 520 and q.y <= 50 for q in by[2])
    again = sampling.sample_squares(zones.orderBy("zone", ascending=False).repartition(3), "zone", 9, 20.0, 50.0, 0.5).collect()
    assert sorted(rows) == sorted(again)
    truth = spark.createDataFrame([(7, [box]), (8, [[(0.0, 0.0), (600.0, 0.0), (600.0, 600.0), (0.0, 600.0)]])], "t long, rings array<array<struct<x:double,y:double>>>")
    clip = sampling.clipped_truth(truth, spark.createDataFrame(rows), "t", "zone", 20.0).collect()
    assert {(c.zone, c.id, c.area) for c in clip if c.t == 8} == {(q.zone, q.id, 400.0) for q in rows}
    assert {c.zone for c in clip if c.t == 7} == {2}


def cells(seed, rows=6, cols=9):
    """Boxes in rows with borders that shift, so that neighbours of two rows share parts of sides."""
    r = random.Random(seed)
    out, n = {}, 0
    for j in range(rows):
        cuts = sorted({0.0, 100.0, *(round(r.uniform(1, 99), 1) for _ in range(cols))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[n] = (a, j * 5.0, b, j * 5.0 + 5)
            n += 1
    return out


def plain_merge(boxes, least):
    """Rounds of pointers over groups, one group after another."""
    area = {k: (x1 - x0) * (y1 - y0) for k, (x0, y0, x1, y1) in boxes.items()}
    length = {}
    for a, (x0, y0, x1, y1) in boxes.items():
        for b, (u0, v0, u1, v1) in boxes.items():
            if a < b:
                w, h = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
                if abs(w) < 1e-9 < h or abs(h) < 1e-9 < w:
                    length[a, b] = max(w, h)
    root = {k: k for k in boxes}
    while True:
        size, near = {}, {}
        for k, r in root.items():
            size[r] = size.get(r, 0) + area[k]
        for (a, b), n in length.items():
            x, y = sorted((root[a], root[b]))
            if x != y:
                near[x, y] = near.get((x, y), 0) + n
        to = {}
        for r in sorted(size):
            if size[r] < least:
                mine = [(round(n, 6), -x, -y) for (x, y), n in near.items() if r in (x, y)]
                if mine:
                    _, x, y = max(mine)
                    to[r] = -x if -y == r else -y
        if not to:
            return root, size
        for r, t in list(to.items()):
            if to.get(t) == r and (size[r] > size[t] or (abs(size[r] - size[t]) < 1e-9 and r < t)):
                to[r] = r
        for k in root:
            r = root[k]
            while to.get(r, r) != r:
                r = to[r]
            root[k] = r


def test_slivers(spark):
    for seed, least in ((1, 40.0), (2, 90.0)):
        boxes = cells(seed)
        boxes[500] = (300.0, 300.0, 301.0, 301.0)  # a sliver that lies alone
        ring = lambda b: [[(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]]
        df = spark.createDataFrame([(k, ring(b)) for k, b in boxes.items()], RINGS)
        got = {m.id: m for m in slivers.merged(df, "id", least, 10.0).withColumn("own", G.polygon_area(slivers.F.col("rings"))).collect()}
        root, size = plain_merge(boxes, least)
        assert got.keys() == size.keys()
        for r, m in got.items():
            assert math.isclose(m.area, size[r], abs_tol=1e-6) and math.isclose(m.own, m.area, abs_tol=1e-5)
            assert m.parts == sum(1 for x in root.values() if x == r)
        assert [r for r, m in got.items() if m.area < least] == [500]
        assert math.isclose(sum(m.area for m in got.values()), sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes.values()), rel_tol=1e-9)
