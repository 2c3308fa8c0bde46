"""Queries for polygons, checked boundaries, names and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import names as N
from terrafold.functions import numbers as M
from terrafold.operators import reports, scenes, spatial
from terrafold.plans.fixtures import view
from terrafold.plans.queries import query


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _triangle(x, y, w, h):
    """A ring with a right angle at (x, y)."""
    return F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + w, y), (x, y + h), (x, y))))


def _upto(a: str, b: str) -> str:
    """SQL: the area of a right triangle (x0, y0, w, h) left of and below a point, in closed form."""
    u = f"least(greatest(({a} - x0) / w, 0), 1)"
    v = f"least(greatest(({b} - y0) / h, 0), 1)"
    return f"(w * h / 2 * (1 - power(1 - {u}, 2) - power(1 - {v}, 2) + power(greatest(1 - {u} - {v}, 0), 2)))"


_SHARED = f"({_upto('r.maxx', 'r.maxy')} - {_upto('r.minx', 'r.maxy')} - {_upto('r.maxx', 'r.miny')} + {_upto('r.minx', 'r.miny')})"


@query(f"""SELECT county_code, round(sum(a), 2) AS area_m2, count(*) AS hits FROM (SELECT r.county_code, {_SHARED} AS a FROM
(SELECT (o_orderkey*37) % 4900 AS x0, (o_custkey*53) % 900 AS y0, (8 + o_orderkey % 90)::DOUBLE AS w, (8 + o_custkey % 70)::DOUBLE AS h FROM orders) t JOIN regions r ON x0 < r.maxx AND x0 + w > r.minx AND y0 < r.maxy AND y0 + h > r.miny) WHERE a > 1e-6 GROUP BY 1""", "regions")
def triangle_area_by_county(spark, d):
    o = _read(spark, d, "orders")
    rings = F.array(_triangle(F.col("o_orderkey") * 37 % 4900, F.col("o_custkey") * 53 % 900, 8 + F.col("o_orderkey") % 90, 8 + F.col("o_custkey") % 70))
    sums = spatial.polygon_area_by_region(o.select(rings.alias("rings")), view(spark, d, "regions"), ["county_code"], 200.0)
    return sums.select("county_code", F.round("area_m2", 2).alias("area_m2"), "hits")


@query(f"""SELECT grid_id, round(a, 4) + 0.0::DOUBLE AS clip_m2, a > 1e-6 AS meets, (xmin_m + 50) / 5000 + (ymin_m + 50) / 1000 < 1 AS centre, a >= 10000 - 1e-6 AS within FROM (SELECT *, {_SHARED} AS a FROM (SELECT 0 AS x0, 0 AS y0, 5000.0::DOUBLE AS w, 1000.0::DOUBLE AS h) t,
(SELECT 'R' || lpad(CAST(9 - gy AS VARCHAR), 5, '0') || 'C' || lpad(CAST(gx AS VARCHAR), 5, '0') AS grid_id, gx * 100.0::DOUBLE AS xmin_m, gy * 100.0::DOUBLE AS ymin_m, gx * 100.0::DOUBLE AS minx, gy * 100.0::DOUBLE AS miny, gx * 100.0::DOUBLE + 100 AS maxx, gy * 100.0::DOUBLE + 100 AS maxy FROM range(50) a(gx), range(10) b(gy)) r)""")
def grid_selection(spark, d):
    extent = view(spark, d, "cities").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    zero = F.lit(0)
    out = spatial.grid_by_boundary(spatial.grid(extent, 100.0), F.array(_triangle(zero, zero, F.lit(5000), F.lit(1000))), 100.0)
    return out.select("grid_id", (F.round("clip_m2", 4) + 0.0).alias("clip_m2"), "meets", "centre", "within")


@query("""SELECT name, code, CASE WHEN ok THEN substr(code, 1, 6) END AS county_code, CASE WHEN ok THEN substr(code, 1, 4) END AS city_code, ok AS valid FROM (SELECT *, regexp_matches(code, '^\\d{6}') AND trim(name) <> '' AS ok FROM
(SELECT CASE WHEN n_nationkey % 9 = 0 THEN ' ' ELSE n_name END AS name, CASE WHEN n_nationkey % 7 = 0 THEN '15x' ELSE '' END || CAST(150100 + n_nationkey AS VARCHAR) AS code FROM nation))""")
def checked_boundaries(spark, d):
    return _counties(spark, d)


def _counties(spark, d):
    n = F.col("n_nationkey")
    rows = _read(spark, d, "nation").select(F.when(n % 9 == 0, " ").otherwise(F.col("n_name")).alias("name"), F.concat(F.when(n % 7 == 0, "15x").otherwise(""), (150100 + n).cast("string")).alias("code"))
    return reports.checked_counties(rows, "name", "code")


@query("""SELECT name, code FROM (SELECT CASE WHEN n_nationkey % 9 = 0 THEN ' ' ELSE n_name END AS name, CASE WHEN n_nationkey % 7 = 0 THEN '15x' ELSE '' END || CAST(150100 + n_nationkey AS VARCHAR) AS code FROM nation)
WHERE NOT (regexp_matches(code, '^\\d{6}') AND trim(name) <> '') ORDER BY code LIMIT 5""")
def boundary_errors(spark, d):
    return reports.first_bad(_counties(spark, d), "code").select("name", "code")


@query("""SELECT r.county_code, r.county_name, c.r_name AS city_name FROM regions r JOIN region c ON substr(r.county_code, 1, 4) = CAST(1501 + c.r_regionkey AS VARCHAR) WHERE c.r_regionkey <> 2""", "regions")
def counties_with_city(spark, d):
    cities = _read(spark, d, "region").where("r_regionkey != 2").select((1501 + F.col("r_regionkey")).cast("string").alias("city_code"), F.col("r_name").alias("city_name"))
    counties = view(spark, d, "regions").select("county_code", "county_name", F.substring("county_code", 1, 4).alias("city_code"))
    return reports.with_city(counties, cities).select("county_code", "county_name", "city_name")


@query("""SELECT w.name, CASE WHEN c.r_name IS NOT NULL THEN CAST(1501 + c.r_regionkey AS VARCHAR) ELSE r.county_code END AS code, CASE WHEN c.r_name IS NOT NULL THEN 'city' WHEN r.county_code IS NOT NULL THEN 'county' ELSE 'none' END AS level
FROM (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT 'nowhere') w LEFT JOIN region c ON c.r_name = w.name LEFT JOIN regions r ON r.county_name = w.name""", "regions")
def boundary_by_level(spark, d):
    cities = _read(spark, d, "region").select(F.col("r_name").alias("name"), (1501 + F.col("r_regionkey")).cast("string").alias("code"))
    counties = view(spark, d, "regions").select(F.col("county_name").alias("name"), F.col("county_code").alias("code"))
    wanted = cities.select("name").union(counties.select("name")).union(spark.sql("SELECT 'nowhere'")).distinct()
    return reports.at_level(wanted, cities, counties)


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'unknown' END AS county FROM part""")
def dictionary_lookup(spark, d):
    p = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("t"), (F.col("p_size") % 4).cast("string")).alias("town"))
    return p.select("p_partkey", reports.looked_up(p, "town", {"t0": "east", "t1": "west"}, "unknown").alias("county"))


@query("""SELECT satellite, day, min(k)[1:15] AS sensing, min(k)[17:] AS prefix, min(prefix) <> max(prefix) AS mixed FROM (SELECT *, sensing || '|' || prefix AS k FROM (SELECT substr(name, 1, 3) AS satellite, substr(name, 12, 8) AS day, substr(name, 12, 15) AS sensing, substr(name, 1, 10) || '_' || substr(name, 39, 6) AS prefix FROM scenes)) GROUP BY 1, 2""", "scenes")
def representative_products(spark, d):
    s = scenes.parsed(view(spark, d, "scenes"))
    p = s.select("satellite", "day", F.substring("name", 12, 15).alias("sensing"), F.concat_ws("_", F.substring("name", 1, 10), "tile").alias("prefix"))
    return reports.representatives(p, ["satellite", "day"])


@query("SELECT substr(name, 39, 6) AS tile, count(*) AS scenes FROM scenes GROUP BY 1 ORDER BY 1", "scenes")
def tile_counts(spark, d):
    return scenes.parsed(view(spark, d, "scenes")).groupBy("tile").agg(F.count("*").alias("scenes")).orderBy("tile")


@query("""SELECT p_brand AS town, count(DISTINCT p_size) AS lists, count(*) AS lines, count(DISTINCT p_type) AS images, count(*) - count(DISTINCT p_type) AS repeated, count(DISTINCT p_type) * 5 AS expected FROM part GROUP BY 1""")
def town_stats(spark, d):
    return reports.town_stats(_read(spark, d, "part").select(F.col("p_brand").alias("town"), F.col("p_size").alias("txt"), F.col("p_type").alias("image")))


@query("SELECT split_part(path, '/', 2) AS folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, round(sum(length) / power(2.0, 30), 6) AS gib, round(sum(length) / 1e9, 6) AS gb FROM (SELECT path, length * 1000000 AS length FROM files) GROUP BY 1", "files")
def folder_sizes(spark, d):
    return reports.folder_sizes(view(spark, d, "files").select("path", (F.col("length") * 1000000).alias("length")))


@query("SELECT p_brand AS category, string_agg(p_partkey, ',' ORDER BY p_partkey) AS tools FROM part GROUP BY 1")
def tools_by_category(spark, d):
    p = _read(spark, d, "part")
    keys = F.array_sort(F.collect_list("p_partkey"))
    return p.groupBy(F.col("p_brand").alias("category")).agg(F.array_join(keys.cast("array<string>"), ",").alias("tools"))


@query("SELECT CAST(count_if(o_orderstatus IN ('O', 'P')) AS BIGINT) AS running, count(*) AS tasks FROM orders")
def running_tasks(spark, d):
    return _read(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("running"), F.count("*").alias("tasks"))


@query("""SELECT *, CAST(index AS VARCHAR) || '/' || CAST(total AS VARCHAR) AS label FROM (SELECT *, CAST(row_number() OVER (ORDER BY satellite, day) AS INTEGER) AS index, count(*) OVER () AS total FROM (SELECT DISTINCT substr(name, 1, 3) AS satellite, substr(name, 12, 8) AS day FROM scenes))""", "scenes")
def numbered_groups(spark, d):
    return reports.numbered(scenes.parsed(view(spark, d, "scenes")).select("satellite", "day").distinct(), ["satellite", "day"])


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value / (event_id % 7), 6) END AS rate, CASE WHEN event_id % 7 = 0 OR value = 0 THEN NULL ELSE round((1000 - value) / (value / (event_id % 7)), 6) END AS remaining FROM events""")
def transfer_rates(spark, d):
    done, elapsed = F.col("value"), F.col("event_id") % 7
    return _read(spark, d, "events").select("event_id", F.round(M.rate(done, elapsed), 6).alias("rate"), F.round(M.remaining(done, F.lit(1000.0), elapsed), 6).alias("remaining"))


@query("""SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS acctbal, 'nation.shp' AS _source_file, 0 AS _source_no FROM nation UNION ALL SELECT s_name, NULL, s_acctbal, 'supplier.shp', 1 FROM supplier""")
def stacked_layers(spark, d):
    n = _read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = _read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return reports.stacked_layers({"nation.shp": n, "supplier.shp": s}).select("name", "region", "acctbal", "_source_file", "_source_no")


@query("""SELECT o_custkey AS city, o_orderdate AS id, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2""")
def distinct_products(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("city"), F.col("o_orderdate").alias("id"), "o_orderkey", "o_totalprice")
    return reports.first_of_each(o, ["city", "id"], "o_orderkey")


@query("""SELECT path FROM files WHERE name LIKE '%.tif' ORDER BY lower(path) LIMIT 200""", "files")
def first_assets(spark, d):
    return reports.first_rows(view(spark, d, "files").where("name like '%.tif'").select("path"), 200, F.lower("path"))


@query("""SELECT p_partkey, 'a_b_' || p_size AS safe, replace(p_name, ' ', '_') AS spaced, 'x_' || p_size AS plain, 'CQDOM1501_20240105_S2_S2A_10m.tif' AS county, '1501_2024.tif' AS city, CASE WHEN p_partkey % 3 = 0 THEN 'run.shp' ELSE p_size || '.shp' END AS result,
CASE WHEN p_partkey % 5 = 0 THEN '/logs/unknown.log' ELSE '/logs/2024-01-05.log' END AS log, 'm1p5_2_' || p_size || '_4p25' AS box FROM part""")
def made_names(spark, d):
    size = F.col("p_size").cast("string")
    p, k = _read(spark, d, "part"), F.col("p_partkey")
    return p.select(
        "p_partkey",
        N.safe_name(F.concat(F.lit(" a:b?"), size, F.lit(". "))).alias("safe"),
        N.single_spaced(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("spaced"),
        N.plain_name(F.concat(F.lit("(x"), F.lit(" %"), size, F.lit(")"))).alias("plain"),
        N.county_file(F.lit("1501"), F.lit("20240105"), F.lit("S2"), F.lit("S2A"), F.lit("10m")).alias("county"),
        N.city_file(F.lit("1501"), F.lit("2024")).alias("city"),
        N.result_name(F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("C:\\out/"), size)), F.lit("run"), ".shp").alias("result"),
        N.log_path("/logs", F.when(k % 5 == 0, "soon").otherwise("2024-01-05T10:00:00")).alias("log"),
        N.box_name(F.lit("-1.5"), F.lit("2"), size, F.lit("4.25")).alias("box"),
    )


@query("""SELECT p_partkey, p_size <= 28 AND p_partkey % 4 <> 0 AS valid, p_partkey % 3 = 0 AS hidden FROM part""")
def checked_names(spark, d):
    day = F.format_string("2024-02-%02d", "p_size")
    start = F.when(F.col("p_partkey") % 4 == 0, "2024/02/01").otherwise("2024-02-01")
    end = F.when(F.col("p_size") <= 28, day).otherwise("2023-12-31")
    name = F.when(F.col("p_partkey") % 6 == 0, ".a").when(F.col("p_partkey") % 3 == 0, "a.TMP.tif").otherwise("a.tif")
    return _read(spark, d, "part").select("p_partkey", N.valid_range(start, end).alias("valid"), N.hidden(name).alias("hidden"))


@query("""SELECT parcel_id, minx - greatest(2 * (maxy - miny) - (maxx - minx), 0) / 2 AS fit_minx, miny - greatest((maxx - minx) / 2 - (maxy - miny), 0) / 2 AS fit_miny, (maxx - 0) * 0.5::DOUBLE AS px, (1000 - maxy) * 0.5::DOUBLE AS py, minx - (maxx - minx) * 0.25 AS wide_minx FROM fields""", "fields")
def fitted_views(spark, d):
    box = [F.col(c) for c in spatial.BOX]
    px, py = M.to_pixel(F.col("maxx"), F.col("maxy"), F.lit(0.0), F.lit(1000.0), F.lit(0.5))
    low, _ = M.expanded(F.col("minx"), F.col("maxx"), 0.25)
    out = view(spark, d, "fields").withColumn("fit", M.fitted(*box, 2.0))
    return out.select("parcel_id", F.col("fit.minx").alias("fit_minx"), F.col("fit.miny").alias("fit_miny"), px.alias("px"), py.alias("py"), low.alias("wide_minx"))


_P = "[2, 4, 8, 16, 32, 64, 128, 256]"


@query(f"""SELECT p_partkey, len(list_filter({_P}, lambda f: p_size * 30 // f >= 1)) AS longest, len(list_filter({_P}, lambda f: p_size * 10 // f >= 128)) AS shorter, len(list_filter({_P}, lambda f: p_size * 10 // f >= 1)) AS both, least(1.0::DOUBLE, 1200.0::DOUBLE / (p_size * 30)) AS scale,
CASE WHEN p_size % 2 = 0 THEN 0.3048::DOUBLE END AS unit, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS predictor, 3 >= p_size AS has_levels FROM part""")
def raster_rules(spark, d):
    w, h = F.col("p_size") * 30, F.col("p_size") * 10
    level = lambda rule: F.size(M.overview_levels(w, h, rule)).cast("long").alias(rule)
    wanted, old = F.sequence(F.lit(1), F.col("p_size")), F.array(*(F.lit(k) for k in (1, 2, 3)))
    return _read(spark, d, "part").select(
        "p_partkey", level("longest"), level("shorter"), level("both"), M.preview_scale(w, h).alias("scale"),
        M.unit_factor(F.lit(0.3048), 0.3048 + F.col("p_size") % 2).alias("unit"),
        M.predictor(F.when(F.col("p_size") % 3 == 0, "float32").otherwise("uint8")).alias("predictor"),
        (F.size(F.array_except(wanted, old)) == 0).alias("has_levels"),
    )


_SHARE = "greatest(least(p.maxx, r.maxx) - greatest(p.minx, r.minx), 0) * greatest(least(p.maxy, r.maxy) - greatest(p.miny, r.miny), 0)"


@query(f"""SELECT source_file, city_code, area_m2, 'ok' AS status FROM (SELECT p.source_file, r.city_code, sum({_SHARE}) AS area_m2 FROM parcels p JOIN cities r ON {_SHARE} > 0 WHERE p.source_file <> 'f3.shp' GROUP BY 1, 2)
UNION ALL SELECT 'none.shp', NULL, NULL, 'no_hit' UNION ALL SELECT 'f3.shp', NULL, NULL, 'failed' UNION ALL SELECT '/locked', NULL, NULL, 'scan_error'""", "cities", "parcels")
def detail_lines(spark, d):
    p = view(spark, d, "parcels")
    hits = spatial.area_by_region(p.where("source_file != 'f3.shp'"), view(spark, d, "cities"), ["city_code"], 200.0, ["source_file"])
    files = p.select("source_file").union(spark.sql("SELECT 'none.shp'")).distinct()
    return reports.detail_lines(hits, files, spark.sql("SELECT 'f3.shp' AS source_file"), spark.sql("SELECT '/locked' AS source_file"))


@query("""SELECT format(E'features: {}\narea_m2: {:.2f}\narea_mu: {:.4f}\nunique_m2: {:.2f}', count(*), sum((maxx - minx) * (maxy - miny)), sum((maxx - minx) * (maxy - miny)) * 0.0015, (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT x, unnest(range(CAST(miny AS BIGINT), CAST(maxy AS BIGINT))) AS y FROM (SELECT DISTINCT unnest(range(CAST(minx AS BIGINT), CAST(maxx AS BIGINT))) AS x, miny, maxy FROM fields)))) AS report FROM fields""", "fields")
def area_report(spark, d):
    f = view(spark, d, "fields")
    sums = f.agg(F.count("*").alias("features"), F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area_m2"))
    unique = spatial.unique_area(f.withColumn("k", F.lit(0)), ["k"], 100.0).select(F.col("unique_area_m2").alias("unique_m2"))
    return reports.area_report(sums.crossJoin(F.broadcast(unique)))  # one row each


@query("""SELECT p_brand AS parent, p_name AS name, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, lower(p_name || p_partkey), p_name || p_partkey) AS INTEGER) AS place FROM part""")
def tree_places(spark, d):
    p = _read(spark, d, "part").select(F.col("p_brand").alias("parent"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 2).alias("is_file"), "p_partkey", "p_name")
    return reports.shown_in_tree(p).select("parent", F.col("p_name").alias("name"), "p_partkey", "place")


@query("""SELECT DISTINCT CAST(greatest(0, least(99, floor((miny + maxy) / 20))) AS INTEGER) AS row, CAST(greatest(0, least(399, floor((minx + maxx) / 20))) AS INTEGER) AS col FROM fields""", "fields")
def reserved_pixels(spark, d):
    return reports.reserved_pixels(view(spark, d, "fields"), 10.0, 400, 100)


@query("""SELECT parcel_id, CASE WHEN w > 0 THEN c END AS col, CASE WHEN w > 0 THEN w END AS width, w <= 0 AS no_coverage FROM (SELECT parcel_id, CAST(floor(minx / 10) AS INTEGER) AS c, CAST(least(400, ceil(maxx / 10)) - floor(minx / 10) AS INTEGER) AS w FROM fields)""", "fields")
def crop_windows(spark, d):
    f = view(spark, d, "fields").withColumn("w", reports.crop_window(*(F.col(c) for c in spatial.BOX), 10.0, 400, 110))
    return f.select("parcel_id", F.col("w.col").alias("col"), F.col("w.width").alias("width"), F.col("w").isNull().alias("no_coverage"))


@query("""SELECT n_nationkey, n_name AS town, '.shp.xml' AS ext, n_name AS bare, '20240105' AS day, 2 AS parts, 'ok' AS plain, CAST(least(60, floor((n_nationkey * 14 - 180 + 180) / 6) + 1) AS INTEGER) AS zone, 5 * power(10, 1)::DOUBLE AS step FROM nation""")
def small_functions(spark, d):
    n = _read(spark, d, "nation")
    return n.select(
        "n_nationkey",
        F.regexp_replace(N.town(F.concat("n_name", F.lit("镇边界.shp"))), "镇$", "").alias("town"),
        N.extension(F.concat("n_name", F.lit(".SHP.XML"))).alias("ext"),
        N.without_safe(F.concat("n_name", F.lit(".SAFE.zip"))).alias("bare"),
        N.compact_date(F.lit("2024-01-05")).alias("day"),
        F.size(N.split_list(F.lit("a，b "))).alias("parts"),
        N.without_escapes(F.lit("\x1b[31mok\x1b[0m")).alias("plain"),
        G.utm_zone(F.col("n_nationkey") * 14 - 180).alias("zone"),
        M.nice_step(F.lit(201.0)).alias("step"),
    )
