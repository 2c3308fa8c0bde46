"""Queries over polygons (concave, holed, crossing themselves), checked by SQL that scans them line by line.

The shapes have whole coordinates and sides that are level, upright or diagonal, so sides cross only at multiples of a
half: between two such heights a scan line at the middle tells the area of the whole stretch exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import generalize, overlay, rasterize
from terrafold.operators.ranges import written
from terrafold.plans.fixtures import view
from terrafold.plans.queries import query


def _spans(points: str, name: str, *keys: str) -> str:
    """SQL: the stretches (a, b) inside each shape on the scan lines y = k / 2 + 1/4."""
    k = ", ".join(keys)
    return f"""{name}_sides AS (SELECT {k}, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {points} WINDOW w AS (PARTITION BY {k}, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_hits AS (SELECT {k}, k, x1 + (k / 2.0::DOUBLE + 0.25 - y1) * (x2 - x1) / (y2 - y1) AS x FROM (SELECT *, unnest(range(CAST(2 * least(y1, y2) AS BIGINT), CAST(2 * greatest(y1, y2) AS BIGINT))) AS k FROM {name}_sides WHERE y1 <> y2)),
{name} AS (SELECT {k}, k, a, b FROM (SELECT {k}, k, x AS a, lead(x) OVER v AS b, row_number() OVER v AS n FROM {name}_hits WINDOW v AS (PARTITION BY {k}, k ORDER BY x)) WHERE n % 2 = 1)"""


def _united(spans: str, *keys: str) -> str:
    """SQL: the area of the union of spans by key."""
    k = ", ".join(keys)
    return f"""SELECT {k}, sum(greatest(b - greatest(a, coalesce(top, a)), 0)) * 0.5 AS area FROM (SELECT *, max(b) OVER (PARTITION BY {k}, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {spans}) GROUP BY ALL HAVING sum(b - a) > 0"""


_SHAPES = ", " + _spans("shape_points", "spans", "parcel_id", "class_code")
_ZONES = ", " + _spans("zone_points", "zspans", "city_code")
_BOTH = f"""{_SHAPES}{_ZONES}, met AS (SELECT city_code, parcel_id, class_code, s.k, greatest(s.a, z.a) AS a, least(s.b, z.b) AS b FROM spans s JOIN zspans z ON s.k = z.k AND s.a < z.b AND z.a < s.b)"""


def shapes(spark, d):
    """(parcel_id, class_code, rings)"""
    return overlay.rings_of(view(spark, d, "shape_points"), "parcel_id", "class_code")


def zones(spark, d):
    return overlay.rings_of(view(spark, d, "zone_points"), "city_code")


def by_class(spark, d):
    return shapes(spark, d).select("class_code", F.col("parcel_id").alias("gid"), F.lit(0).alias("side"), "rings")


@query(f"""{_SHAPES} SELECT parcel_id, round(sum(b - a) * 0.5, 4) AS area FROM spans GROUP BY 1""", "shape_points")
def repaired_shapes(spark, d):
    return overlay.repaired(shapes(spark, d), "parcel_id", 100.0).select("parcel_id", F.round("area", 4).alias("area"))


@query("""SELECT o_orderkey AS parcel_id, CAST(CASE o_orderkey % 7 WHEN 4 THEN 1 ELSE 2 END AS BIGINT) AS crossings FROM orders WHERE o_orderkey % 7 IN (4, 6)""")
def invalid_shapes(spark, d):
    return overlay.self_crossing(shapes(spark, d), "parcel_id")


@query(f"""{_SHAPES} SELECT class_code, round(area, 4) AS area FROM ({_united("spans", "class_code")})""", "shape_points")
def united_shape_area(spark, d):
    return overlay.overlay_area(by_class(spark, d), ["class_code"], 250.0).select("class_code", F.round("area", 4).alias("area"))


@query(f"""{_SHAPES} SELECT class_code, round(area, 2) AS area FROM ({_united("spans", "class_code")})""", "shape_points")
def dissolved_classes(spark, d):
    """The rings' areas, holes below zero, add up to the area of the union."""
    return overlay.dissolved(by_class(spark, d), ["class_code"], 250.0).groupBy("class_code").agg(F.round(F.sum("area"), 2).alias("area"))


@query(f"""{_BOTH} SELECT city_code, class_code, round(sum(b - a) * 0.5, 4) AS area_m2, count(DISTINCT parcel_id) AS hits FROM met GROUP BY 1, 2""", "shape_points", "zone_points")
def shape_area_by_zone(spark, d):
    s = shapes(spark, d)
    pairs = overlay.shared_area(s, zones(spark, d), 100.0, "parcel_id", "city_code").join(s.select("parcel_id", "class_code"), "parcel_id")
    return pairs.groupBy("city_code", "class_code").agg(F.round(F.sum("area"), 4).alias("area_m2"), F.count("*").alias("hits"))


@query(f"""{_BOTH} SELECT city_code, round(sum(b - a) * 0.5, 2) AS area_m2, count(DISTINCT parcel_id) AS shapes FROM met GROUP BY 1""", "shape_points", "zone_points")
def shapes_clipped_by_zone(spark, d):
    """Each zone gets the parts of the shapes that lie in it, as rings."""
    parts = overlay.clipped(shapes(spark, d), zones(spark, d), 250.0, "parcel_id", "city_code")
    own = F.aggregate(F.transform("rings", G.ring_area), F.lit(0.0), lambda s, a: s + a)
    return parts.groupBy("city_code").agg(F.round(F.sum(own), 2).alias("area_m2"), F.count("*").alias("shapes"))


@query(f"""{_BOTH}, u AS ({_united("met", "city_code")}), z AS (SELECT city_code, sum(b - a) * 0.5 AS whole FROM zspans GROUP BY 1)
SELECT city_code, round(least(100, greatest(0, area / whole * 100)), 4) AS percent, round(whole - area, 2) AS missing_m2 FROM u JOIN z USING (city_code)""", "shape_points", "zone_points")
def zone_coverage(spark, d):
    return overlay.coverage(shapes(spark, d), zones(spark, d), "city_code", 250.0).select("city_code", F.round("percent", 4).alias("percent"), F.round("missing_m2", 2).alias("missing_m2"))


GRID = rasterize.Grid(0.0, 1024.0, 8.0, 640, 128)

#: SQL: the coverage of pixels of 8 m by 8 x 8 centres, each tested against the sides of each shape whose box holds it.
_CENTRES = f"""{_SHAPES}, boxes AS (SELECT parcel_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM shape_points GROUP BY 1),
centres AS (SELECT parcel_id, cx, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS cy FROM (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS cx FROM boxes)),
held AS (SELECT DISTINCT cx, cy FROM (SELECT parcel_id, cx, cy FROM centres JOIN spans_sides s USING (parcel_id) WHERE (s.y1 > cy + 0.5) <> (s.y2 > cy + 0.5) AND s.x1 + (cy + 0.5 - s.y1) * (s.x2 - s.x1) / (s.y2 - s.y1) <= cx + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1)),
cover AS (SELECT CAST((1023 - cy) // 8 AS INTEGER) AS row, CAST(cx // 8 AS INTEGER) AS col, CAST(count(*) AS INTEGER) AS coverage FROM held GROUP BY 1, 2)"""

#: SQL: a point inside each shape, and its pixel.
_POINTS = """mid AS (SELECT parcel_id, (min(y) + max(y)) / 2 AS m FROM shape_points GROUP BY 1),
scan AS (SELECT p.parcel_id, (max(y) FILTER (y <= m) + min(y) FILTER (y > m)) / 2 AS y FROM shape_points p JOIN mid USING (parcel_id) GROUP BY 1),
cuts AS (SELECT parcel_id, y, x, lead(x) OVER v AS x2, row_number() OVER v AS n FROM (SELECT s.parcel_id, y, x1 + (x2 - x1) * ((y - y1) / (y2 - y1)) AS x FROM scan JOIN spans_sides s USING (parcel_id) WHERE (y1 > y) <> (y2 > y)) WINDOW v AS (PARTITION BY parcel_id ORDER BY x)),
points AS (SELECT parcel_id, x + (x2 - x) / 2 AS x, y FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY x2 - x DESC, x) AS best FROM cuts WHERE n % 2 = 1) WHERE best = 1),
kept AS (SELECT DISTINCT CAST(greatest(0, least(127, floor((1024 - y) / 8))) AS INTEGER) AS row, CAST(greatest(0, least(639, floor(x / 8))) AS INTEGER) AS col FROM points)"""


@query(f"""{_CENTRES} SELECT row, col, coverage FROM cover""", "shape_points")
def shape_coverage(spark, d):
    return rasterize.coverage(shapes(spark, d), "parcel_id", GRID)


@query(f"""{_SHAPES}, {_POINTS} SELECT parcel_id, round(x, 6) AS x, round(y, 6) AS y FROM points""", "shape_points")
def inner_points(spark, d):
    p = shapes(spark, d).select("parcel_id", G.representative_point(F.col("rings")).alias("p"))
    return p.select("parcel_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""{_CENTRES}, {_POINTS}, one AS (SELECT CAST(round_even((SELECT area FROM ({_united("(SELECT 1 AS u, k, a, b FROM spans)", "u")})) / 64, 0) AS BIGINT) - (SELECT count(*) FROM kept) AS want),
free AS (SELECT * FROM cover ANTI JOIN kept USING (row, col)), lv AS (SELECT coverage, count(*) AS n FROM free GROUP BY 1), run AS (SELECT *, sum(n) OVER (ORDER BY coverage DESC) AS upto FROM lv),
cut AS (SELECT coalesce(max(coverage), 0) AS level, coalesce(CAST(arg_max(want - (upto - n), coverage) AS BIGINT), 0) AS need FROM run, one WHERE upto > want),
last AS (SELECT row, col, row // 32 AS gy, col // 32 AS gx, need FROM free, cut WHERE coverage = level AND need > 0),
b AS (SELECT gy, gx, count(*) AS c, max(need) AS need FROM last GROUP BY 1, 2), q AS (SELECT *, CAST(sum(c) OVER (ORDER BY gy, gx) AS BIGINT) AS upto, CAST(sum(c) OVER () AS BIGINT) AS total FROM b),
k AS (SELECT gy, gx, c, (upto * need) // total - ((upto - c) * need) // total AS k FROM q), pick AS (SELECT gy, gx, CAST(floor((i + 0.5) * c / k) AS BIGINT) AS place FROM (SELECT *, unnest(range(k)) AS i FROM k)),
pl AS (SELECT row, col, gy, gx, row_number() OVER (PARTITION BY gy, gx ORDER BY row, col) - 1 AS place FROM last)
SELECT row, col FROM kept UNION ALL SELECT row, col FROM free, cut WHERE coverage > level UNION ALL SELECT row, col FROM pl JOIN pick USING (gy, gx, place)""", "shape_points")
def area_matched_shapes(spark, d):
    s = written(shapes(spark, d), "shapes")  # read for the area, the coverage and the points
    area = overlay.overlay_area(s.select(F.lit(1).alias("u"), F.col("parcel_id").alias("gid"), F.lit(0).alias("side"), "rings"), ["u"], 250.0)
    return rasterize.area_matched(rasterize.coverage(s, "parcel_id", GRID), rasterize.reserved(s, GRID), area, GRID.size, 32)


_TOUCH = """, zs AS (SELECT city_code, x AS x1, 1024 - y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, 1024 - coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM zone_points WINDOW w AS (PARTITION BY city_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
zp AS (SELECT city_code, row, unnest(range(c0 * 8, (c1 + 1) * 8, 8)) // 8 AS col FROM (SELECT city_code, floor(least(x1, x2) / 8)::BIGINT AS c0, floor(greatest(x1, x2) / 8)::BIGINT AS c1, unnest(range(floor(least(y1, y2) / 8)::BIGINT, floor(greatest(y1, y2) / 8)::BIGINT + 1)) AS row FROM zs)),
zc AS (SELECT DISTINCT city_code, row, col FROM zp), edge AS (SELECT DISTINCT c.city_code, row, col FROM zc c JOIN zs s ON s.city_code = c.city_code
AND least(x1, x2) < col * 8 + 8 AND (greatest(x1, x2) > col * 8 OR least(x1, x2) = col * 8) AND least(y1, y2) < row * 8 + 8 AND (greatest(y1, y2) > row * 8 OR least(y1, y2) = row * 8)
AND (x1 = x2 OR y1 = y2 OR (greatest(least(x1, x2), col * 8) < least(greatest(x1, x2), col * 8 + 8) AND greatest(least(y1 + (greatest(least(x1, x2), col * 8) - x1) * (y2 - y1) / (x2 - x1), y1 + (least(greatest(x1, x2), col * 8 + 8) - x1) * (y2 - y1) / (x2 - x1)), row * 8) < least(greatest(y1 + (greatest(least(x1, x2), col * 8) - x1) * (y2 - y1) / (x2 - x1), y1 + (least(greatest(x1, x2), col * 8 + 8) - x1) * (y2 - y1) / (x2 - x1)), row * 8 + 8)))),
mid AS (SELECT c.city_code, row, col FROM (SELECT city_code, row, unnest(range(125)) + first AS col FROM (SELECT city_code, unnest(range(3, 128)) AS row, CAST(min(x) // 8 AS BIGINT) AS first FROM zone_points GROUP BY 1)) c JOIN zs s ON s.city_code = c.city_code AND (y1 > row * 8 + 4) <> (y2 > row * 8 + 4) AND x1 + (row * 8 + 4 - y1) * (x2 - x1) / (y2 - y1) <= col * 8 + 4 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"""{_TOUCH} SELECT city_code, (SELECT count(*) FROM mid m WHERE m.city_code = z.city_code) AS centres, (SELECT count(*) FROM (SELECT * FROM mid UNION SELECT * FROM edge) m WHERE m.city_code = z.city_code) AS touched FROM (SELECT DISTINCT city_code FROM zone_points) z""", "zone_points")
def zone_pixels(spark, d):
    """Pixels of each zone by both rules."""
    count = lambda every, name: rasterize.inside(zones(spark, d), ["city_code"], GRID, every).groupBy("city_code").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias(name))
    return count(False, "centres").join(count(True, "touched"), "city_code")


@query(""", zs AS (SELECT city_code, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM zone_points WINDOW w AS (PARTITION BY city_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hit AS (SELECT city_code, p.raster_id, p.row, p.col FROM pixels p JOIN zs s ON (s.y1 > 1024 - (p.row + 0.5) * 8) <> (s.y2 > 1024 - (p.row + 0.5) * 8) AND x1 + (1024 - (p.row + 0.5) * 8 - y1) * (x2 - x1) / (y2 - y1) <= (p.col + 0.5) * 8 WHERE p.value <> 0 GROUP BY ALL HAVING count(*) % 2 = 1),
n AS (SELECT city_code, count(*) AS n FROM (SELECT DISTINCT city_code, row, col FROM hit) GROUP BY 1) SELECT z.city_code, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'created' ELSE 'no_coverage' END AS status FROM (SELECT DISTINCT city_code FROM zone_points) z LEFT JOIN n USING (city_code)""", "zone_points", "pixels")
def zone_clips(spark, d):
    return rasterize.clip_status(view(spark, d, "pixels"), zones(spark, d), "city_code", GRID)


@query("""SELECT parcel_id, round(sum(ax * by_ - bx * ay) / 2, 4) AS area, count(*) AS corners FROM (SELECT a.parcel_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM (SELECT DISTINCT parcel_id, x, y FROM shape_points) a JOIN (SELECT DISTINCT parcel_id, x, y FROM shape_points) b ON a.parcel_id = b.parcel_id AND (a.x <> b.x OR a.y <> b.y)
JOIN (SELECT DISTINCT parcel_id, x, y FROM shape_points) p ON p.parcel_id = a.parcel_id GROUP BY ALL HAVING min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) >= 0
AND count_if((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) < 0 OR (p.x - b.x) * (a.x - b.x) + (p.y - b.y) * (a.y - b.y) < 0)) = 0) GROUP BY 1""", "shape_points")
def shape_hulls(spark, d):
    h = generalize.hulls(view(spark, d, "shape_points"), "parcel_id")
    return h.select("parcel_id", F.round(G.ring_area(F.col("ring")), 4).alias("area"), (F.size("ring") - 1).cast("long").alias("corners"))


@query("""SELECT source_file, count(*) AS shown, max(feature_no) AS last, max(length(name)) AS widest FROM (SELECT *, min(CASE WHEN bad THEN feature_no END) OVER (PARTITION BY source_file) AS stop FROM
(SELECT concat('f', CAST(o_orderkey % 40 AS VARCHAR), '.shp') AS source_file, o_orderkey // 40 AS feature_no, o_orderkey % 1009 = 700 AS bad, substr(repeat(o_orderpriority, 40), 1, 180) AS name FROM orders)) WHERE feature_no < 800 AND feature_no < coalesce(stop, 1000000000) GROUP BY 1""")
def layer_previews(spark, d):
    names = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("parcel_id"), F.create_map(F.lit("name"), F.repeat("o_orderpriority", 40)).alias("attributes"))
    file, no = F.concat(F.lit("f"), (F.col("parcel_id") % 40).cast("string"), F.lit(".shp")), F.expr("parcel_id div 40")
    f = shapes(spark, d).join(names, "parcel_id").select(file.alias("source_file"), no.alias("feature_no"), F.when(F.col("parcel_id") % 1009 != 700, F.col("rings")).alias("rings"), "attributes")
    return generalize.preview(f).groupBy("source_file").agg(F.count("*").alias("shown"), F.max("feature_no").alias("last"), F.max(F.length(F.col("properties")["name"])).cast("long").alias("widest"))
