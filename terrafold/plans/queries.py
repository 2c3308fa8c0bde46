"""Queries for the operators, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import names as N
from terrafold.functions import numbers as M
from terrafold.operators import manifest, raster, scenes, spatial, tables, tasks
from terrafold.plans.fixtures import using, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (using(*views) if views else "") + sql
        return f

    return add


_SHARE = "greatest(least(p.maxx, r.maxx) - greatest(p.minx, r.minx), 0) * greatest(least(p.maxy, r.maxy) - greatest(p.miny, r.miny), 0)"
_MEET = "p.minx < r.maxx AND r.minx < p.maxx AND p.miny < r.maxy AND r.miny < p.maxy"


@query(f"""SELECT r.city_code, r.county_code, sum({_SHARE}) AS area_m2, count(*) AS hits, round(sum({_SHARE}) * 0.0015, 6) AS area_mu
FROM parcels p JOIN regions r ON {_MEET} GROUP BY ALL""", "regions", "parcels")
def area_by_county(spark, d):
    return spatial.area_by_region(view(spark, d, "parcels"), view(spark, d, "regions"), ["city_code", "county_code"], 200.0)


@query(f"""SELECT c.city_code, coalesce(sum(a), 0) AS area_m2, count(a) AS files, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits FROM cities c
LEFT JOIN (SELECT r.city_code, p.source_file, sum({_SHARE}) AS a, count(*) AS h FROM parcels p JOIN cities r ON {_MEET} GROUP BY ALL) s ON s.city_code = c.city_code GROUP BY c.city_code""", "cities", "parcels")
def city_totals(spark, d):
    return spatial.region_totals(view(spark, d, "parcels"), view(spark, d, "cities"), ["city_code"], 200.0)


@query(f"""SELECT p.source_file, r.city_code, sum({_SHARE}) AS area_m2, count(*) AS hits, round(sum({_SHARE}) * 0.0015, 6) AS area_mu FROM parcels p JOIN cities r ON {_MEET} GROUP BY ALL""", "cities", "parcels")
def area_by_file_and_city(spark, d):
    return spatial.area_by_region(view(spark, d, "parcels"), view(spark, d, "cities"), ["city_code"], 200.0, ["source_file"])


@query("""SELECT source_file, sum((maxx - minx) * (maxy - miny)) AS area_m2, count(*) AS features, CAST(count_if(class_code = 'R') AS BIGINT) AS class_r FROM parcels GROUP BY ALL""", "parcels")
def area_by_file(spark, d):
    p = view(spark, d, "parcels")
    return p.groupBy("source_file").agg(F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area_m2"), F.count("*").alias("features"), F.count_if(F.col("class_code") == "R").alias("class_r"))


@query("""SELECT class_code, CAST(count(*) AS DOUBLE) AS unique_area_m2 FROM (
SELECT DISTINCT class_code, x, unnest(range(CAST(miny AS BIGINT), CAST(maxy AS BIGINT))) AS y FROM (
SELECT DISTINCT class_code, unnest(range(CAST(minx AS BIGINT), CAST(maxx AS BIGINT))) AS x, miny, maxy FROM parcels)) GROUP BY class_code""", "parcels")
def unique_area_by_class(spark, d):
    return spatial.unique_area(view(spark, d, "parcels"), ["class_code"], 100.0)


@query("""SELECT 'R' || lpad(CAST(9 - gy AS VARCHAR), 5, '0') || 'C' || lpad(CAST(gx AS VARCHAR), 5, '0') AS grid_id, CAST(9 - gy AS INTEGER) AS row, CAST(gx AS INTEGER) AS col,
gx * 100.0::DOUBLE AS xmin_m, gy * 100.0::DOUBLE AS ymin_m, 100.0::DOUBLE AS size_m, 10000.0::DOUBLE AS area_m2 FROM range(50) a(gx), range(10) b(gy)""")
def province_grid(spark, d):
    extent = view(spark, d, "cities").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return spatial.grid(extent, 100.0)


@query(f"""SELECT p.parcel_id AS a, r.parcel_id AS b, {_SHARE} AS area FROM fields p JOIN fields r ON p.parcel_id < r.parcel_id AND {_MEET} WHERE {_SHARE} >= 0.00666667""", "fields")
def overlapping_fields(spark, d):
    return spatial.overlaps(view(spark, d, "fields"), "parcel_id", 50.0, 0.00666667)


@query("""SELECT source_file, area_before, parcels_before, area_after, parcels_after, area_after - area_before AS difference, round(abs(area_after - area_before) / area_before * 100, 4) AS percent FROM (
SELECT source_file, sum((maxx - minx) * (maxy - miny)) AS area_before, count(*) AS parcels_before, coalesce(sum((maxx - minx) * (maxy - miny)) FILTER (class_code <> 'A'), 0) AS area_after, count(*) FILTER (class_code <> 'A') AS parcels_after FROM parcels GROUP BY 1)""", "parcels")
def compared_periods(spark, d):
    p = view(spark, d, "parcels")
    return spatial.compared(p, p.where("class_code != 'A'"))


@query("""SELECT class_code, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, floor(min(minx) / 30) * 30 AS ax, ceil(max(maxx) / 30) * 30 AS bx FROM parcels GROUP BY 1""", "parcels")
def layer_bounds(spark, d):
    low, high = M.aligned(F.col("minx"), F.col("maxx"), 30.0)
    b = view(spark, d, "parcels").groupBy("class_code").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return b.withColumn("ax", low.cast("double")).withColumn("bx", high.cast("double"))


@query("""SELECT parcel_id, (maxx - minx) * (maxy - miny) AS area, minx + 3.5 AS sx, maxy - 2.25 AS sy, minx <= 100 AND maxx > 100 AND miny <= 50 AND maxy > 50 AS holds,
'POLYGON((' || CAST(minx AS VARCHAR) || ' ' || CAST(miny AS VARCHAR) || ',' || CAST(maxx AS VARCHAR) || ' ' || CAST(miny AS VARCHAR) || ',' || CAST(maxx AS VARCHAR) || ' ' || CAST(maxy AS VARCHAR) || ',' || CAST(minx AS VARCHAR) || ' ' || CAST(maxy AS VARCHAR) || ',' || CAST(minx AS VARCHAR) || ' ' || CAST(miny AS VARCHAR) || '))' AS wkt FROM fields""", "fields")
def shifted_rings(spark, d):
    f = view(spark, d, "fields").withColumn("ring", G.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))).withColumn("rings", F.array("ring"))
    moved = G.bounds(G.translated(F.col("rings"), 3.5, -2.25))
    return f.select("parcel_id", G.polygon_area(F.col("rings")).alias("area"), moved["minx"].alias("sx"), moved["maxy"].alias("sy"), G.covers_point(F.col("rings"), F.lit(100.0), F.lit(50.0)).alias("holds"), G.wkt(F.col("ring")).alias("wkt"))


@query("""SELECT raster_id, count(*) AS n_valid, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, round(count(*) * 100.0 / 16384, 4) AS percent FROM (SELECT DISTINCT raster_id, row, col FROM pixels WHERE value <> 0) GROUP BY 1""", "pixels")
def valid_footprints(spark, d):
    return raster.footprints(view(spark, d, "pixels"), 16384)


def _stretch_sql(lo: str, hi: str) -> str:
    return f"""SELECT p.raster_id, p.row, p.col, p.band, CASE WHEN p.value > 0 THEN CAST(floor(least(greatest((p.value - lo) / ((CASE WHEN hi <= lo THEN lo + 1 ELSE hi END) - lo), 0.0::DOUBLE), 1.0::DOUBLE) * 255) AS INTEGER) ELSE 255 END AS shown
FROM pixels p LEFT JOIN (SELECT raster_id, band, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi FROM pixels WHERE value > 0 GROUP BY 1, 2) l ON p.raster_id = l.raster_id AND p.band = l.band"""


@query(_stretch_sql("min(value)", "max(value)"), "pixels")
def preview_minmax(spark, d):
    return raster.stretch(view(spark, d, "pixels"), "minmax")


@query(_stretch_sql("0", "max(value)"), "pixels")
def preview_max(spark, d):
    return raster.stretch(view(spark, d, "pixels"), "max")


@query(_stretch_sql("quantile_cont(value, 0.02)", "quantile_cont(value, 0.98)"), "pixels")
def preview_percentile(spark, d):
    return raster.stretch(view(spark, d, "pixels"), "percentile")


@query("""SELECT row, col, band, arg_min(value, raster_id) AS value, min(raster_id) AS source FROM pixels WHERE value <> 0 GROUP BY 1, 2, 3""", "pixels")
def first_valid_mosaic(spark, d):
    return raster.mosaic(view(spark, d, "pixels"))


@query("""SELECT r.county_code, p.raster_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM pixels p JOIN regions r ON (p.col + 0.5) * 40 >= r.minx AND (p.col + 0.5) * 40 < r.maxx AND (p.row + 0.5) * 40 >= r.miny AND (p.row + 0.5) * 40 < r.maxy WHERE value <> 0 GROUP BY 1, 2""", "pixels", "regions")
def county_clip_counts(spark, d):
    c = raster.clipped(view(spark, d, "pixels"), view(spark, d, "regions").select("county_code", "minx", "miny", "maxx", "maxy"), 40.0)
    return c.groupBy("county_code", "raster_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT raster_id, band, CAST(floor(row / 4) AS INTEGER) AS row, CAST(floor(col / 4) AS INTEGER) AS col, round(avg(value), 6) AS value FROM pixels WHERE value <> 0 GROUP BY ALL""", "pixels")
def pyramid_level(spark, d):
    return raster.pyramid(view(spark, d, "pixels"), 4).withColumn("value", F.round("value", 6))


_COVER = """sub AS (SELECT DISTINCT sr, unnest(range(CAST(minx * 0.4 AS BIGINT), CAST(maxx * 0.4 AS BIGINT) + 2)) AS sc, minx, maxx FROM (SELECT unnest(range(CAST(miny * 0.4 AS BIGINT), CAST(maxy * 0.4 AS BIGINT) + 2)) AS sr, miny, maxy, minx, maxx FROM fields) WHERE (sr + 0.5) * 2.5 >= miny AND (sr + 0.5) * 2.5 < maxy),
hit AS (SELECT DISTINCT sr, sc FROM sub WHERE (sc + 0.5) * 2.5 >= minx AND (sc + 0.5) * 2.5 < maxx),
cover AS (SELECT CAST(floor(sr / 4) AS INTEGER) AS row, CAST(floor(sc / 4) AS INTEGER) AS col, CAST(count(*) AS INTEGER) AS coverage FROM hit GROUP BY 1, 2)"""


@query(f", {_COVER} SELECT coverage, count(*) AS pixels FROM cover GROUP BY 1", "fields")
def coverage_histogram(spark, d):
    return raster.coverage_histogram(raster.coverage(view(spark, d, "fields"), 10.0, 4))


_SELECTED = f""", {_COVER}, h AS (SELECT coverage, count(*) AS pixels FROM cover GROUP BY 1),
run AS (SELECT *, sum(pixels) OVER (ORDER BY coverage DESC) AS upto FROM h), cut AS (SELECT coverage AS level, 5000 - (upto - pixels) AS need FROM run WHERE upto > 5000 ORDER BY coverage DESC LIMIT 1),
lv AS (SELECT row, col, floor(row / 16) AS yb, floor(col / 16) AS xb, need FROM cover, cut WHERE coverage = level),
b AS (SELECT yb, xb, count(*) AS c, max(need) AS need FROM lv GROUP BY 1, 2),
q AS (SELECT *, sum(c) OVER (ORDER BY yb, xb) AS upto, sum(c) OVER () AS total FROM b),
k AS (SELECT yb, xb, c, CAST(floor(CAST(upto * need AS DOUBLE) / total) - floor(CAST((upto - c) * need AS DOUBLE) / total) AS BIGINT) AS k FROM q),
pick AS (SELECT yb, xb, CAST(floor((i + 0.5) * c / k) AS BIGINT) AS place FROM (SELECT *, unnest(range(k)) AS i FROM k)),
pl AS (SELECT row, col, yb, xb, row_number() OVER (PARTITION BY yb, xb ORDER BY row, col) - 1 AS place FROM lv)
SELECT row, col FROM cover, cut WHERE coverage > level UNION ALL SELECT row, col FROM pl JOIN pick USING (yb, xb, place)"""


@query(_SELECTED, "fields")
def area_matched_pixels(spark, d):
    return raster.selected(raster.coverage(view(spark, d, "fields"), 10.0, 4), 5000, 16)


@query("""SELECT parcel_id, CAST(sum(n) AS BIGINT) AS pixels, CAST(CASE WHEN keep THEN best ELSE 0 END AS INTEGER) AS class, CAST(CASE WHEN keep THEN most ELSE e END AS BIGINT) AS n FROM (
SELECT *, e * 2 <= sum(n) OVER (PARTITION BY parcel_id) AND best IS NOT NULL AS keep FROM (
SELECT parcel_id, class, n, sum(CASE WHEN class = 0 THEN n ELSE 0 END) OVER (PARTITION BY parcel_id) AS e, max(CASE WHEN class <> 0 THEN n END) OVER (PARTITION BY parcel_id) AS most,
first_value(CASE WHEN class <> 0 THEN class END) OVER (PARTITION BY parcel_id ORDER BY class = 0, n DESC, class) AS best FROM (
SELECT f.parcel_id, x.value % 4 AS class, count(*) AS n FROM fields f JOIN pixels x ON (x.col + 0.5) * 40 >= f.minx AND (x.col + 0.5) * 40 < f.maxx AND (x.row + 0.5) * 8 * 5 >= f.miny AND (x.row + 0.5) * 40 < f.maxy GROUP BY 1, 2))) GROUP BY parcel_id, keep, best, most, e""", "fields", "pixels")
def parcel_votes(spark, d):
    px = view(spark, d, "pixels").withColumn("class", F.col("value") % 4)
    return raster.votes(px.select("row", "col", "class"), view(spark, d, "fields"), 40.0)


@query("""SELECT n, round(hit / n, 6) AS accuracy, round((hit / n - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) FILTER (t = p) AS DOUBLE) AS hit, (SELECT CAST(sum(a.c * b.c) AS DOUBLE) FROM (SELECT l_returnflag AS t, count(*) AS c FROM lineitem GROUP BY 1) a JOIN (SELECT l_linestatus AS p, count(*) AS c FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS l_linestatus FROM lineitem) GROUP BY 1) b ON t = p) AS ch FROM (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS p, count(*) AS c FROM lineitem GROUP BY 1, 2))""")
def self_check_accuracy(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("t"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("p"))
    return raster.confusion(rows, "t", "p")


@query(r"""SELECT satellite, day, count(*) AS scenes, min(path) AS first_path, CASE WHEN count(DISTINCT tile) = 1 THEN min(tile) ELSE 'MULTI' END AS label FROM (SELECT path, substr(name, 1, 3) AS satellite, substr(name, 12, 8) AS day, substr(name, 39, 6) AS tile FROM scenes) GROUP BY 1, 2""", "scenes")
def scene_groups(spark, d):
    g = scenes.grouped(scenes.parsed(view(spark, d, "scenes")), ["satellite", "day"])
    return g.select("satellite", "day", "scenes", F.col("paths")[0].alias("first_path"), "label")


@query(f"""SELECT r.city_code, substr(p.name, 1, 3) AS satellite, substr(p.name, 12, 8) AS day, string_agg(DISTINCT p.path, ',' ORDER BY p.path) AS paths, count(DISTINCT p.path) AS scenes FROM scenes p JOIN cities r ON {_MEET} GROUP BY ALL""", "cities", "scenes")
def scenes_by_city(spark, d):
    return scenes.by_region(scenes.parsed(view(spark, d, "scenes")), view(spark, d, "cities"), ["satellite", "day"], 250.0)


@query("""SELECT satellite, day, city_code, round(least(100, greatest(0, n / 10000.0)), 4) AS percent, round(greatest(1000000 - n, 0), 4)::DOUBLE AS missing_m2 FROM (
SELECT satellite, day, city_code, sum(greatest(b - greatest(a, coalesce(top, a)), 0)) AS n FROM (SELECT *, max(b) OVER (PARTITION BY satellite, day, city_code, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
SELECT DISTINCT satellite, day, c.city_code, y, greatest(s.minx, c.minx) AS a, least(s.maxx, c.maxx) AS b FROM (SELECT substr(name, 1, 3) AS satellite, substr(name, 12, 8) AS day, minx, maxx, unnest(range(CAST(miny AS BIGINT), CAST(maxy AS BIGINT))) AS y FROM scenes) s
JOIN cities c ON s.minx < c.maxx AND s.maxx > c.minx AND y >= c.miny AND y < c.maxy)) GROUP BY 1, 2, 3)""", "cities", "scenes")
def city_coverage(spark, d):
    return scenes.covered(scenes.parsed(view(spark, d, "scenes")), view(spark, d, "cities"), 250.0, ["satellite", "day"])


@query("""SELECT path, name, first_value(path) OVER w AS adopted, row_number() OVER w > 1 AS duplicate FROM files WINDOW w AS (PARTITION BY lower(name) ORDER BY lower(path), path)""", "files")
def duplicate_files(spark, d):
    return manifest.adopted(view(spark, d, "files").select("path", "name"))


@query(r"""SELECT path, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '(\.[^.]*)$', '') || '_重复' || CAST(n - 1 AS VARCHAR) || regexp_extract(name, '(\.[^.]*)$', 1) END AS target FROM (SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY path) AS n FROM files)""", "files")
def unique_targets(spark, d):
    return manifest.unique_names(view(spark, d, "files").select("path", "name")).select("path", "target")


@query("""SELECT coalesce(lower(a.rel_path), lower(b.rel_path)) AS rel_path, a.length AS l_length, a.hash AS l_hash, b.length AS r_length, b.hash AS r_hash,
CASE WHEN b.length IS NULL THEN 'only_left' WHEN a.length IS NULL THEN 'only_right' WHEN a.length <> b.length THEN 'size_differs' WHEN a.hash <> b.hash THEN 'hash_differs' ELSE 'same' END AS status FROM files_left a FULL JOIN files_right b ON lower(a.rel_path) = lower(b.rel_path)""", "files_left", "files_right")
def folder_differences(spark, d):
    return manifest.compared(view(spark, d, "files_left"), view(spark, d, "files_right"))


@query("""SELECT status, count(*) AS files FROM (SELECT CASE WHEN b.length IS NULL THEN 'only_left' WHEN a.length IS NULL THEN 'only_right' WHEN a.length <> b.length THEN 'size_differs' WHEN a.hash <> b.hash THEN 'hash_differs' ELSE 'same' END AS status FROM files_left a FULL JOIN files_right b ON lower(a.rel_path) = lower(b.rel_path)) GROUP BY 1""", "files_left", "files_right")
def folder_summary(spark, d):
    return manifest.compared(view(spark, d, "files_left"), view(spark, d, "files_right")).groupBy("status").agg(F.count("*").alias("files"))


@query("""SELECT w.name, s.path, s.length, CASE WHEN s.path IS NULL THEN 'missing' WHEN t.length IS NULL THEN 'copy' WHEN t.length = s.length THEN 'existing' ELSE 'conflict' END AS action
FROM (SELECT DISTINCT p_brand || CAST(p_size + 20 AS VARCHAR) || '.tif' AS name FROM part) w LEFT JOIN (SELECT lower(name) AS k, min(path) AS path, arg_min(length, path) AS length FROM files GROUP BY 1) s ON lower(w.name) = s.k
LEFT JOIN (SELECT lower(name) AS k, min(length + p_partkey % 2) AS length FROM files WHERE p_partkey % 4 = 0 GROUP BY 1) t ON lower(w.name) = t.k""", "files")
def copy_plan(spark, d):
    f = view(spark, d, "files")
    wanted = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", (F.col("p_size") + 20).cast("string"), F.lit(".tif")).alias("name")).distinct()
    return manifest.copy_plan(wanted, f, f.where("p_partkey % 4 = 0").withColumn("length", F.col("length") + F.col("p_partkey") % 2))


@query("""SELECT f.name, arg_max(t.town, length(t.town)) AS town FROM (SELECT DISTINCT name FROM files) f LEFT JOIN (SELECT DISTINCT p_brand AS town FROM part UNION SELECT DISTINCT p_brand || '1' FROM part) t ON contains(regexp_replace(f.name, '\\.[^.]+$', ''), t.town) GROUP BY 1""", "files")
def longest_town(spark, d):
    brand = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("town")).distinct()
    return manifest.towns_of(view(spark, d, "files").select("name").distinct(), brand.union(brand.select(F.concat("town", F.lit("1")))))


@query("""SELECT m.path AS main, f.path, f.path <> m.path AS sidecar FROM (SELECT * FROM files WHERE path LIKE '%.tif') m JOIN files f ON regexp_replace(lower(m.path), '\\.[a-z]+$', '') = regexp_replace(lower(f.path), '\\.[a-z]+$', '') AND regexp_replace(m.path, '[^/]*$', '') = regexp_replace(f.path, '[^/]*$', '')""", "files")
def sidecar_files(spark, d):
    f = view(spark, d, "files").select("path")
    return manifest.with_sidecars(f.where("path like '%.tif'"), f)


_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS sequence FROM task_events)"


@query(f", {_SEQ} SELECT event_id, task_id, sequence FROM seq", "task_events")
def event_sequences(spark, d):
    return tasks.sequenced(view(spark, d, "task_events")).select("event_id", "task_id", F.col("sequence").cast("long"))


@query(f", {_SEQ} SELECT task_id, event_id, sequence FROM seq WHERE sequence > 60", "task_events")
def event_replay(spark, d):
    return tasks.replay(tasks.sequenced(view(spark, d, "task_events")), 60).select("task_id", "event_id", F.col("sequence").cast("long"))


@query(f", {_SEQ} SELECT task_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sequence DESC) AS k FROM seq) WHERE k <= 5", "task_events")
def event_tail(spark, d):
    return tasks.tail(tasks.sequenced(view(spark, d, "task_events")), 5).select("task_id", "event_id")


@query(f", {_SEQ} SELECT task_id, arg_max(type, sequence) AS type, max(sequence) AS last_sequence FROM seq GROUP BY 1", "task_events")
def task_states(spark, d):
    return tasks.latest(tasks.sequenced(view(spark, d, "task_events"))).select("task_id", "type", F.col("last_sequence").cast("long"))


@query(f", {_SEQ}, p AS (SELECT task_id, sequence, floor(sequence / 2 / 5) * 5 AS bucket FROM seq) SELECT task_id, CAST(sequence AS BIGINT) AS sequence, CAST(bucket AS BIGINT) AS bucket FROM (SELECT *, lag(bucket) OVER (PARTITION BY task_id ORDER BY sequence) AS b FROM p) WHERE b IS NULL OR b <> bucket", "task_events")
def progress_marks(spark, d):
    p = tasks.sequenced(view(spark, d, "task_events")).select("task_id", F.col("sequence").cast("long"), (F.col("sequence") / 2).alias("percent"))
    return tasks.progress_marks(p).select("task_id", "sequence", F.col("bucket").cast("long"))


@query(f", {_SEQ} " + "SELECT task_id, round(list_reduce(list(value ORDER BY sequence), lambda s, v: s * (1 - 0.35::DOUBLE) + v * 0.35::DOUBLE), 6) AS speed FROM seq GROUP BY 1", "task_events")
def smoothed_speed(spark, d):
    return tasks.smoothed(tasks.sequenced(view(spark, d, "task_events")).withColumnRenamed("value", "speed"))


@query("""SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 8 AS slot, CAST(least(floor(((row_number() OVER (ORDER BY event_id) - 1) % 8) / 3), 1) AS INTEGER) AS client FROM task_events""", "task_events")
def round_robin_slots(spark, d):
    return tasks.round_robin(view(spark, d, "task_events").select("event_id"), "event_id", 8, 3, 2).withColumn("slot", F.col("slot").cast("long"))


@query(r"""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN contains(event_type, 'ERROR') THEN 'error' ELSE 'info' END AS level FROM events""")
def event_payloads(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), N.log_level(F.col("event_type")).alias("level"))


@query("""SELECT n_name || '市' AS raw, trim(n_name) AS name, CAST(1501 + n_regionkey AS VARCHAR) || '02' AS code FROM nation""")
def normal_regions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat("n_name", F.lit("市")).alias("raw"), F.concat((1501 + F.col("n_regionkey")).cast("string"), F.lit("02.0")).alias("c"))
    return n.select("raw", N.region_name(F.concat(F.lit("  "), "raw", F.lit(" "))).alias("name"), N.numeric_code(F.col("c"), 6).alias("code"))


@query(r"""SELECT p_partkey, '/mnt/nas/' || p_brand || '/a.tif' AS mounted, '\\10.0.0.1\data\' || p_brand || '\a.tif' AS shared, 'a' AS stem FROM part""")
def share_paths(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("\\\\10.0.0.1\\DATA\\"), "p_brand", F.lit("\\a.tif")).alias("unc"))
    mounted = N.mounted(F.col("unc"), {"\\\\10.0.0.1\\data": "/mnt/nas"})
    return p.select("p_partkey", mounted.alias("mounted"), N.shared(mounted, "/mnt/nas", "\\\\10.0.0.1\\data").alias("shared"), N.stem(F.col("unc")).alias("stem"))


@query("""SELECT c_custkey, CASE WHEN b >= 1048576 THEN format('{:.2f} MB', b / 1048576.0) WHEN b >= 1024 THEN format('{:.2f} KB', b / 1024.0) ELSE CAST(b AS VARCHAR) || ' B' END AS size,
CASE WHEN s >= 3600 THEN format('{}h{:02d}m{:02d}s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS elapsed FROM (SELECT c_custkey, c_custkey * 997 AS b, c_custkey * 7 AS s FROM customer)""")
def formatted_sizes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", N.byte_size(F.col("c_custkey") * 997).alias("size"), N.elapsed((F.col("c_custkey") * 7).cast("double")).alias("elapsed"))


@query("""SELECT p_partkey, array_to_string(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda f: (p_size * 300) // f >= 256), ',') AS factors, p_size IN (2, 4, 8, 16, 32) AS power FROM part""")
def pyramid_factors(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    f = M.overview_factors(F.col("p_size") * 300, F.col("p_size") * 100)
    return p.select("p_partkey", F.array_join(f.cast("array<string>"), ",").alias("factors"), M.power_of_two(F.col("p_size")).alias("power"))


@query("""SELECT k AS parcel_id, CASE WHEN n.v IS NOT NULL THEN n.v ELSE o.v END AS v, CASE WHEN n.v IS NOT NULL THEN n.s ELSE o.s END AS s FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0) x
LEFT JOIN (SELECT p_partkey, p_brand AS v, 1 AS s FROM part WHERE p_partkey % 3 <> 0) o ON o.p_partkey = k LEFT JOIN (SELECT p_partkey, p_type AS v, 1 + p_partkey % 5 AS s FROM part WHERE p_partkey % 2 = 0) n ON n.p_partkey = k""")
def upserted_rows(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    old = p.where("p_partkey % 3 != 0").selectExpr("p_partkey AS parcel_id", "p_brand AS v", "1L AS s")
    new = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS parcel_id", "p_type AS v", "1 + p_partkey % 5 AS s")
    return tables.upserted(old, new, "parcel_id", "s")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def unfinished_jobs(spark, d):
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.without(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT c_mktsegment AS name, min(c_custkey) AS place FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 3) GROUP BY 1")
def available_in_order(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_mktsegment", "name")
    return tables.wanted_in_order(c.select("name", F.col("c_custkey").alias("place")), c.where("c_acctbal > 9000 and c_nationkey < 3"), "name", "place")


@query("""SELECT f.name, f.code, r.county_name, CASE WHEN f.code IS NULL THEN 'invalid' WHEN r.county_name IS NULL THEN 'unknown' ELSE 'matched' END AS status FROM (SELECT name, CASE WHEN k % 10 <> 0 THEN substr(name, 1, 6) END AS code FROM
(SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE '' END || CAST(150101 + 100 * (p_partkey % 7) + p_partkey % 6 AS VARCHAR) || '_a.tif' AS name FROM part)) f LEFT JOIN regions r ON r.county_code = f.code""", "regions")
def files_by_code(spark, d):
    n = F.concat(F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(""), (150101 + 100 * (F.col("p_partkey") % 7) + F.col("p_partkey") % 6).cast("string"), F.lit("_a.tif"))
    return tables.by_code(spark.read.parquet(f"{d}/part.parquet").select(n.alias("name")), view(spark, d, "regions").select("county_code", "county_name")).select("name", "code", "county_name", "status")


@query("""SELECT w.wanted, arg_min(r.county_code, (CASE WHEN r.county_name = w.wanted THEN '0' ELSE '1' END) || r.county_code) AS county_code, arg_min(r.county_name, (CASE WHEN r.county_name = w.wanted THEN '0' ELSE '1' END) || r.county_code) AS county_name
FROM (SELECT DISTINCT substr(n_name, 1 + n_nationkey % 3, 4 + n_nationkey % 6) AS wanted FROM nation UNION SELECT 'nowhere') w LEFT JOIN regions r ON contains(r.county_name, w.wanted) GROUP BY 1""", "regions")
def named_regions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    wanted = n.selectExpr("substr(n_name, 1 + n_nationkey % 3, 4 + n_nationkey % 6) AS wanted").union(spark.sql("SELECT 'nowhere'")).distinct()
    return tables.best_name(wanted, view(spark, d, "regions"))


@query("""SELECT p_partkey, p_size, last_value(v IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS v FROM part)""")
def merged_cells(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("v"))
    return tables.filled_down(p, "v", "p_size", "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def newest_tasks(spark, d):
    return tables.newest(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 500)


@query("""SELECT o_custkey, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda s: NOT list_contains(h, s))), ',') AS missing, len(list_filter(['F', 'O', 'P'], lambda s: NOT list_contains(h, s))) = 0 AS complete FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS h FROM orders GROUP BY 1)""")
def complete_groups(spark, d):
    return tables.complete(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query(f"""SELECT CASE WHEN sa >= sb THEN b ELSE a END AS parcel_id, sum(area) AS lost_m2, count(*) AS overlaps FROM (SELECT p.parcel_id AS a, r.parcel_id AS b, {_SHARE} AS area, (p.maxx - p.minx) * (p.maxy - p.miny) AS sa, (r.maxx - r.minx) * (r.maxy - r.miny) AS sb
FROM fields p JOIN fields r ON p.parcel_id < r.parcel_id AND {_MEET}) GROUP BY 1""", "fields")
def topology_losses(spark, d):
    return spatial.overlap_losses(view(spark, d, "fields"), "parcel_id", 50.0)


@query(f"""SELECT c.city_code, format('{{:.6f}}', coalesce(sum(a), 0) * 0.0015) AS area_mu, format('{{:.4f}}', coalesce(sum(a), 0)) AS area_m2, count(a) AS files, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits FROM cities c
LEFT JOIN (SELECT r.city_code, p.source_file, sum({_SHARE}) AS a, count(*) AS h FROM parcels p JOIN cities r ON {_MEET} GROUP BY ALL) s ON s.city_code = c.city_code GROUP BY c.city_code""", "cities", "parcels")
def city_summary_lines(spark, d):
    return tables.summary_lines(city_totals(spark, d))


@query("""SELECT raster_id, row, col, max(value) FILTER (band = 1) AS "1", max(value) FILTER (band = 2) AS "2" FROM (SELECT raster_id, row, col, 1 + col % 2 AS band, value FROM pixels) GROUP BY 1, 2, 3""", "pixels")
def stacked_bands(spark, d):
    return tables.stacked(view(spark, d, "pixels").withColumn("band", 1 + F.col("col") % 2), [1, 2])


@query("SELECT task_id, status, created_at FROM (SELECT user_id AS task_id, CASE WHEN user_id % 3 = 0 THEN 'running' ELSE 'completed' END AS status, max(ts) AS created_at FROM events GROUP BY 1) WHERE status = 'running' OR task_id IN (SELECT task_id FROM (SELECT user_id AS task_id, max(ts) AS m FROM events WHERE user_id % 3 <> 0 GROUP BY 1) ORDER BY m DESC, task_id DESC LIMIT greatest(0, 70 - (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 = 0)))")
def kept_tasks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("task_id")).agg(F.max("ts").alias("created_at"))
    return tasks.evicted(e.select("task_id", F.when(F.col("task_id") % 3 == 0, "running").otherwise("completed").alias("status"), "created_at"), 70)
