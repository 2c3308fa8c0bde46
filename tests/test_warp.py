"""Warping against a direct computation, and projections there and back."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions.geometry import Albers, reprojected
from terrafold.operators import warp
from terrafold.operators.rasterize import Grid


@pytest.mark.parametrize("albers", [Albers(), Albers(-20.0, -40.0, -30.0, 20.0), Albers(30.0, 30.0)])
def test_round_trip(spark, albers):
    r = random.Random(4)
    rows = [(r.uniform(-60, 60) + albers.lon_0, r.uniform(-80, 80)) for _ in range(400)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = albers.forward(F.col("lon"), F.col("lat"))
    lon, lat = albers.inverse(F.col("x"), F.col("y"))
    for p in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(p.lon - p.lon2) < 1e-9 and abs(p.lat - p.lat2) < 1e-9


def test_reprojected_rings(spark):
    a = Albers()
    df = spark.createDataFrame([([[(104.0, 30.0), (106.0, 30.0), (106.0, 33.0)], []],), (None,)], "rings array<array<struct<x:double,y:double>>>")
    there = df.select(reprojected(F.col("rings"), a.forward).alias("rings"))
    back = [r.rings for r in there.select(reprojected(F.col("rings"), a.inverse).alias("rings")).collect()]
    assert back[1] is None and [len(r) for r in back[0]] == [3, 0] and all(math.isclose(p.x, x, abs_tol=1e-9) for p, x in zip(back[0][0], (104, 106, 106), strict=True))


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic"])
def test_warped(spark, how):
    """A turned and stretched raster: each target pixel against its neighbours in one array, over tile borders and gaps."""
    r = np.random.default_rng(6)
    source = r.integers(1, 1000, (50, 70)).astype(float)
    source[r.random(source.shape) < 0.05] = 0
    s, c = math.sin(0.3), math.cos(0.3)
    forward = lambda x, y: (x * c - y * s, x * s + y * c)
    inverse = lambda x, y: (x * c + y * s, y * c - x * s)
    grid, target = Grid(10.0, 60.0, 1.0, 70, 50), Grid(-15.0, 90.0, 1.3, 80, 70)
    rows = [(3, i, j, 1, float(v)) for (i, j), v in np.ndenumerate(source)] + [(4, 0, 0, 2, 5.0), (4, 0, 1, 2, None)]
    df = spark.createDataFrame(rows, "raster_id long, row int, col int, band int, value double")
    got = {(p.raster_id, p.row, p.col): p.value for p in warp.warped(df, warp.Frame(grid, forward, inverse), target, how, 16).collect()}
    value = lambda i, j: source[i, j] if 0 <= i < 50 and 0 <= j < 70 and source[i, j] else None
    want = {}
    for i in range(70):
        for j in range(80):
            x, y = inverse(-15 + (j + 0.5) * 1.3, 90 - (i + 0.5) * 1.3)
            u, v = x - 10, 60 - y
            if not (0 <= u < 70 and 0 <= v < 50):
                continue
            if how == "nearest":
                found = value(int(v), int(u))
            else:
                a, b = math.floor(v - 0.5), math.floor(u - 0.5)
                fr, fc = v - 0.5 - a, u - 0.5 - b
                four = [(w * q, value(a + k, b + m)) for k, w in ((0, 1 - fr), (1, fr)) for m, q in ((0, 1 - fc), (1, fc))]
                weight = sum(w for w, z in four if z is not None)
                found = sum(w * z for w, z in four if z is not None) / weight if weight else None
                if how == "cubic":
                    k = lambda t: [-t / 2 + t * t - t**3 / 2, 1 - 2.5 * t * t + 1.5 * t**3, t / 2 + 2 * t * t - 1.5 * t**3, -t * t / 2 + t**3 / 2]
                    all16 = [(p * q, value(a + m - 1, b + n - 1)) for m, p in enumerate(k(fr)) for n, q in enumerate(k(fc))]
                    found = sum(w * z for w, z in all16) if all(z is not None for _, z in all16) else found
            if found is not None:
                want[3, i, j] = found
    mine = {k: v for k, v in got.items() if k[0] == 3}
    assert mine.keys() == want.keys() and len(want) > 1500
    assert all(math.isclose(mine[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    assert all(v == 5.0 for k, v in got.items() if k[0] == 4)


def test_empty_and_kinds(spark):
    df = spark.createDataFrame([], "raster_id long, row int, col int, band int, value double")
    same = lambda x, y: (x, y)
    assert warp.warped(df, warp.Frame(Grid(0, 4, 1, 4, 4), same, same), Grid(0, 4, 1, 4, 4)).collect() == []
    kinds = spark.createDataFrame([("a", 4, "uint16"), ("a", 4, "uint16"), ("b", 4, "uint16"), ("b", 3, "uint16"), ("c", 4, "uint8"), ("c", 4, "uint16")], "g string, bands int, dtype string")
    assert sorted(tuple(r) for r in warp.kinds_differ(kinds, ["g"]).collect()) == [("b", "bands: 3 and 4"), ("c", "uint16 and uint8")]


def test_pixels_beside_the_frame(spark):
    """Tiles beyond the source's or the target's end ask for no target pixels, and no place outside of the target is mapped back."""
    same = lambda x, y: (x, y)
    grid, target = Grid(0.0, 100.0, 1.0, 40, 100), Grid(0.0, 100.0, 1.0, 40, 30)
    held = lambda x, y: (x, F.when(y < 70, F.raise_error(F.lit("below the target"))).otherwise(y))
    tiles = spark.createDataFrame([(r, ty, 0) for r in (1, 2) for ty in (0, 1, 2, 5, 500, -3)], "raster_id long, ty long, tx long")
    points = warp.target_points(tiles, warp.Frame(grid, same, held), target, 10)
    assert {(p.raster_id, p.row) for p in points.collect()} == {(r, row) for r in (1, 2) for row in range(30)}
    df = spark.createDataFrame([(1, i, 3, 1, 1.0 + i) for i in (0, 29, 30, 31, 55, 99, 100, 5000)], "raster_id long, row int, col int, band int, value double")
    assert sorted((p.row, p.col, p.value) for p in warp.warped(df, warp.Frame(grid, same, held), target, "nearest", 10).collect()) == [(0, 3, 1.0), (29, 3, 30.0)]
    low = warp.warped(df, warp.Frame(grid, same, same), Grid(0.0, 99.75, 1.0, 40, 200), "bilinear", 10)
    got = {p.row: p.value for p in low.collect() if p.col == 3}
    assert set(got) == {0, 28, 29, 30, 31, 54, 55, 98, 99} and got[99] == pytest.approx(100.25)  # a neighbour below the source's end counts
