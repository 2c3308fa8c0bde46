"""Geometry as columns: rings are array<struct<x, y>>, polygons array<ring> (first the shell, then holes)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The ring of a box, closed."""
    points = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace sum; a ring that isn't closed is closed."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the shell less its holes; null or empty gives 0."""
    sizes = F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r))))
    return F.coalesce(F.aggregate(sizes, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))


def translated(rings: Column, dx: float, dy: float) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))


def bounds(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share; ``a`` and ``b`` are the prefixes of their minx, miny, maxx and maxy columns."""
    width = F.least(F.col(f"{a}maxx"), F.col(f"{b}maxx")) - F.greatest(F.col(f"{a}minx"), F.col(f"{b}minx"))
    height = F.least(F.col(f"{a}maxy"), F.col(f"{b}maxy")) - F.greatest(F.col(f"{a}miny"), F.col(f"{b}miny"))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def clipped_ring(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A ring cut by a box, one side after another. Where a concave ring falls apart, its parts stay joined by
    edges along the box, which have no area: sums over the ring are those of the parts."""
    for axis, low, high in (("x", minx, maxx), ("y", miny, maxy)):
        for bound, sign in ((low, 1), (high, -1)):
            ring = _cut(ring, axis, bound, sign)
    return ring


def _cut(ring: Column, axis: str, bound: Column, sign: int) -> Column:
    def edge(a: Column, b: Column) -> Column:
        da, db = (a[axis] - bound) * sign, (b[axis] - bound) * sign
        t = da / (da - db)
        at = lambda c: bound if c == axis else a[c] + (b[c] - a[c]) * t
        crossing = F.struct(at("x").cast("double").alias("x"), at("y").cast("double").alias("y"))
        crosses = ((da < 0) & (db > 0)) | ((da > 0) & (db < 0))
        own = F.when(da >= 0, F.array(a)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.when(crosses, F.concat(own, F.array(crossing))).otherwise(own)

    def run(r: Column) -> Column:
        after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.flatten(F.zip_with(r, after, edge))

    return F.element_at(F.transform(F.array(ring), run), 1)


def clipped_area(rings: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Area that a polygon (shell and holes, concave too) shares with a box."""
    return polygon_area(F.transform(rings, lambda r: clipped_ring(r, minx, miny, maxx, maxy)))


def wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit("))"))


def covers_point(rings: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside, by the even-odd rule over all rings (so holes are outside)."""

    def crossings(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        hits = F.zip_with(ring, after, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
        return F.aggregate(hits, F.lit(0), lambda s, v: s + v)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, v: s + v) % 2 == 1


def representative_point(rings: Column) -> Column:
    """A point inside the shape (even-odd rule): the middle of the widest stretch on a level line near its middle.

    The line lies between the nearest heights of corners, so it meets none. Null if the shape has no area."""
    corners = F.flatten(F.filter(rings, lambda r: r.isNotNull()))
    ys = F.transform(corners, lambda p: p["y"])
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    line = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2

    def hits(y: Column, ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        at = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]))
        return F.filter(F.zip_with(ring, after, at), lambda x: x.isNotNull())

    def inside(y: Column) -> Column:
        xs = F.array_sort(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: hits(y, r))))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("width"), (-F.get(xs, i)).alias("left")))
        widest = F.array_max(pairs)
        return F.when((F.size(xs) > 1) & (widest["width"] > 0), F.struct((widest["width"] / 2 - widest["left"]).alias("x"), y.alias("y")))

    return F.get(F.transform(F.filter(F.array(line), lambda y: y.isNotNull()), inside), F.lit(0))


def utm_zone(lon: Column) -> Column:
    """The plain 6-degree zone."""
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic on an ellipsoid, with the closed forward formulas."""

    lat_1: float = 25.0
    lat_2: float = 47.0
    lat_0: float = 0.0
    lon_0: float = 105.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    def _q(self, phi: float) -> float:
        e = math.sqrt(self.f * (2 - self.f))
        s = math.sin(phi)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) in metres of degrees; one expression in the plan, no function calls from Python."""
        e = math.sqrt(self.f * (2 - self.f))
        p1, p2, p0 = (math.radians(v) for v in (self.lat_1, self.lat_2, self.lat_0))
        m1, m2 = (math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2))
        n = (m1 * m1 - m2 * m2) / (self._q(p2) - self._q(p1)) if p1 != p2 else math.sin(p1)
        c = m1 * m1 + n * self._q(p1)
        rho0 = self.a * math.sqrt(c - n * self._q(p0)) / n
        s = F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - (e * s) * (e * s)) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho = self.a * F.sqrt(c - n * q) / n
        theta = n * F.radians(lon - self.lon_0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)


    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees of metres: the latitude by Newton steps, folded over a fixed number of rounds."""
        e = math.sqrt(self.f * (2 - self.f))
        p1, p2, p0 = (math.radians(v) for v in (self.lat_1, self.lat_2, self.lat_0))
        m1, m2 = (math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2))
        n = (m1 * m1 - m2 * m2) / (self._q(p2) - self._q(p1)) if p1 != p2 else math.sin(p1)
        c = m1 * m1 + n * self._q(p1)
        rho0 = self.a * math.sqrt(c - n * self._q(p0)) / n
        down = rho0 - y
        sign = math.copysign(1.0, n)
        rho = F.sqrt(x * x + down * down)
        q = (c - (rho * n / self.a) * (rho * n / self.a)) / n

        def step(phi: Column, q: Column) -> Column:
            s = F.sin(phi)
            w = 1 - (e * s) * (e * s)
            return phi + w * w / (2 * F.cos(phi)) * (q / (1 - e * e) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

        rounds = F.sequence(F.lit(1), F.lit(7))
        phi = F.get(F.transform(F.array(q), lambda v: F.aggregate(rounds, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / 2))), lambda p, _: step(p, v))), F.lit(0))
        return self.lon_0 + F.degrees(F.atan2(sign * x, sign * down) / n), F.degrees(phi)


def reprojected(rings: Column, project) -> Column:
    """Rings with every point moved by ``project`` (x, y) -> (x, y), such as ``Albers.forward`` or ``Albers.inverse``."""

    def point(p: Column) -> Column:
        x, y = project(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))


def densified_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column, project, points: int = 21) -> Column:
    """Bounds of a projected box, from ``points`` more points on each edge."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda i: i / (points + 1.0))
    along = lambda a, b: (lambda t: a + (b - a) * t)
    edges = []
    for fx, fy in ((along(minx, maxx), lambda t: miny), (along(minx, maxx), lambda t: maxy), (lambda t: minx, along(miny, maxy)), (lambda t: maxx, along(miny, maxy))):
        edges.append(_edge(steps, fx, fy, project))
    all_points = F.concat(*edges)
    xs, ys = F.transform(all_points, lambda p: p["x"]), F.transform(all_points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _edge(steps: Column, fx, fy, project) -> Column:
    def point(t: Column) -> Column:
        x, y = project(fx(t), fy(t))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(steps, point)
