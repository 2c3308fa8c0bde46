"""Queries over reprojected rasters; the SQL maps each target pixel back by the same formulas and looks its neighbours up."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions.geometry import Albers
from terrafold.operators import warp
from terrafold.operators.rasterize import Grid
from terrafold.plans.fixtures import view
from terrafold.plans.queries import query

ALBERS = Albers()
SOURCE = Grid(110.0, 42.0, 0.0005, 128, 1200)
TARGET = Grid(408000.0, 4536300.0, 60.0, 160, 1300)
FRAME = warp.Frame(SOURCE, ALBERS.forward, ALBERS.inverse)


def _constants() -> dict[str, float]:
    import math

    a = ALBERS
    e = math.sqrt(a.f * (2 - a.f))
    p1, p2 = math.radians(a.lat_1), math.radians(a.lat_2)
    m1, m2 = (math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2))
    n = (m1 * m1 - m2 * m2) / (a._q(p2) - a._q(p1))
    c = m1 * m1 + n * a._q(p1)
    return {"e": e, "n": n, "c": c, "rho0": a.a * math.sqrt(c) / n}


_K = {k: f"{v!r}::DOUBLE" for k, v in _constants().items()}
_STEP = "phi + power(1 - power({e} * sin(phi), 2), 2) / (2 * cos(phi)) * (q / (1 - {e} * {e}) - sin(phi) / (1 - power({e} * sin(phi), 2)) + ln((1 - {e} * sin(phi)) / (1 + {e} * sin(phi))) / (2 * {e}))".format(**_K)
#: SQL: the source column u and row v of every target pixel's centre.
_BACK = (
    f""", g AS (SELECT row, col, {TARGET.left} + (col + 0.5) * {TARGET.size} AS x, {TARGET.top} - (row + 0.5) * {TARGET.size} AS y FROM (SELECT unnest(range({TARGET.height})) AS row), (SELECT unnest(range({TARGET.width})) AS col)),
q AS (SELECT row, col, degrees(atan2(x, {_K["rho0"]} - y) / {_K["n"]}) + {ALBERS.lon_0} AS lon, ({_K["c"]} - (x * x + power({_K["rho0"]} - y, 2)) * power({_K["n"]} / {ALBERS.a}, 2)) / {_K["n"]} AS q FROM g),
p0 AS (SELECT *, asin(q / 2) AS phi FROM q)"""
    + "".join(f", p{k} AS (SELECT row, col, lon, q, {_STEP} AS phi FROM p{k - 1})" for k in range(1, 8))
    + f""", back AS (SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, (lon - {SOURCE.left}) / {SOURCE.size} AS u, ({SOURCE.top} - degrees(phi)) / {SOURCE.size} AS v FROM p7)
, inside AS (SELECT * FROM back WHERE u >= 0 AND v >= 0 AND u < {SOURCE.width} AND v < {SOURCE.height})"""
)


@query(f"""{_BACK} SELECT CAST(raster_id AS BIGINT) AS raster_id, b.row, b.col, CAST(value AS DOUBLE) AS value FROM inside b JOIN pixels p ON p.row = floor(v) AND p.col = floor(u) WHERE value <> 0""", "pixels")
def warped_nearest(spark, d):
    return warp.warped(view(spark, d, "pixels"), FRAME, TARGET, "nearest", 64).select("raster_id", "row", "col", "value")


@query(f"""{_BACK}, near AS (SELECT row, col, u - 0.5 - c AS fc, v - 0.5 - r AS fr, CAST(r AS INTEGER) + i AS pr, CAST(c AS INTEGER) + j AS pc, i, j FROM (SELECT *, floor(v - 0.5) AS r, floor(u - 0.5) AS c FROM inside), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
w AS (SELECT n.*, p.raster_id, p.value, (CASE i WHEN 0 THEN 1 - fr ELSE fr END) * (CASE j WHEN 0 THEN 1 - fc ELSE fc END) AS w FROM near n JOIN pixels p ON p.row = pr AND p.col = pc WHERE p.value <> 0)
SELECT CAST(w.raster_id AS BIGINT) AS raster_id, w.row, w.col, round(sum(w * value) / sum(w), 3) AS value FROM w GROUP BY 1, 2, 3 HAVING sum(w) > 0""", "pixels")
def warped_bilinear(spark, d):
    return warp.warped(view(spark, d, "pixels"), FRAME, TARGET, "bilinear", 64).select("raster_id", "row", "col", F.round("value", 3).alias("value"))


@query(f"""{_BACK} SELECT b.row, b.col, CAST(arg_min(value, raster_id) AS DOUBLE) AS value, CAST(min(raster_id) AS BIGINT) AS source FROM inside b JOIN pixels p ON p.row = floor(v) AND p.col = floor(u) WHERE value <> 0 GROUP BY 1, 2""", "pixels")
def reprojected_mosaic(spark, d):
    return warp.reprojected_mosaic(view(spark, d, "pixels"), FRAME, TARGET, 64).select("row", "col", "value", "source")
