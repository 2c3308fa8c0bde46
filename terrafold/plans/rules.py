"""Queries over row rules, each on rows of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import names as N
from terrafold.operators import reports, rules, scenes
from terrafold.plans.fixtures import view
from terrafold.plans.queries import query


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""SELECT p_partkey, CASE WHEN shp IS NULL AND tif IS NULL THEN NULL ELSE coalesce(shp, tif) || '.shp' END AS shp, CASE WHEN shp IS NULL AND tif IS NULL THEN NULL ELSE coalesce(tif, shp) || '.tif' END AS tif, CASE WHEN shp IS NULL AND tif IS NULL THEN 'no name' END AS error FROM (
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_brand || '.' || p_size END AS shp, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE 't' || p_size END AS tif FROM part)""")
def result_file_names(spark, d):
    """Wanted names with other suffixes, none, folders before them, blanks, or nothing at all."""
    k, stem = F.col("p_partkey") % 5, F.concat("p_brand", F.lit("."), "p_size")
    shp = F.when(k == 0, "  ").when(k == 2, F.concat(F.lit("C:\\out\\"), stem, F.lit(".TIF"))).when(k > 2, F.concat(F.lit(" /a/"), stem, F.lit(".shp ")))
    tif = F.when(k == 1, F.concat(F.lit("t"), "p_size")).when(k > 2, F.concat(F.lit("t"), "p_size", F.lit(".shp"))).when(k == 2, "")
    return _read(spark, d, "part").select("p_partkey", N.result_names(shp, tif).alias("n")).select("p_partkey", "n.*")


@query("""SELECT code AS county_code, min(name) AS county_name, city AS city_name, CASE WHEN min(name) <> max(name) THEN min(name) || ' / ' || max(name) END AS error FROM (
SELECT CAST(1501 + c_nationkey % 5 AS VARCHAR) || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS code, r_name AS city, CASE WHEN c_custkey % 97 < 3 THEN c_mktsegment ELSE 'C' || c_custkey % 97 END AS name FROM customer JOIN region ON r_regionkey = c_nationkey % 5 WHERE c_custkey % 11 <> 0) GROUP BY code, city""")
def region_conflicts(spark, d):
    """Codes that stand for counties of several names are told."""
    c = _read(spark, d, "customer")
    code = F.concat((1501 + F.col("c_nationkey") % 5).cast("string"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"))
    name = F.when(F.col("c_custkey") % 11 == 0, "  ").when(F.col("c_custkey") % 97 < 3, F.col("c_mktsegment")).otherwise(F.concat(F.lit(" C"), F.col("c_custkey") % 97))
    counties = c.select(code.alias("county_code"), name.alias("county_name"), F.substring(code, 1, 4).alias("city_code"))
    cities = _read(spark, d, "region").select((1501 + F.col("r_regionkey")).cast("string").alias("city_code"), F.col("r_name").alias("city_name"))
    return reports.with_city(counties, cities)


@query("""SELECT o_custkey, start <= e AND length(e) = 10 AS valid FROM (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS start, CASE WHEN o_custkey % 3 = 0 THEN '2024-02-30' WHEN o_custkey % 3 = 1 THEN strftime(max(o_orderdate), '%Y-%m-%d') ELSE strftime(max(o_orderdate), '%Y-%m-%dT') END AS e FROM orders GROUP BY 1)""")
def checked_date_ranges(spark, d):
    day = lambda f: F.date_format(f("o_orderdate"), "yyyy-MM-dd")
    o = _read(spark, d, "orders").groupBy("o_custkey").agg(day(F.min).alias("a"), day(F.max).alias("b"))
    end = F.when(F.col("o_custkey") % 3 == 0, "2024-02-30").when(F.col("o_custkey") % 3 == 1, F.col("b")).otherwise(F.concat("b", F.lit("T")))
    return o.select("o_custkey", N.valid_range(F.col("a"), end).alias("valid"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'contains(Name,''' || ['', 'GRD', 'L2A', 'L1C'][1 + user_id % 4] || ''') and ' END || 'Collection/Name eq ''' || ['LANDSAT-8', 'SENTINEL-1', 'SENTINEL-2', 'SENTINEL-2'][1 + user_id % 4] || ''''
|| CASE WHEN event_id % 3 = 0 THEN '' ELSE ' and OData.CSC.Intersects(area=geography''SRID=4326;POINT(' || event_id || ' 1)'')' END || CASE WHEN user_id % 4 >= 2 AND event_id % 5 <> 0 THEN ' and Attributes/OData.CSC.DoubleAttribute/any(att:att/Name eq ''cloudCover'' and att/OData.CSC.DoubleAttribute/Value le ' || event_id % 100 || ')' ELSE '' END
|| ' and ContentDate/Start ge ' || strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z and ContentDate/Start le ' || strftime(ts, '%Y-%m-%d') || 'T23:59:59.999Z' AS filter FROM events""")
def catalogue_filters(spark, d):
    e, day = _read(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd")
    kind = F.get(F.array(*map(F.lit, ("landsat-8", "Sentinel-1-GRD", "sentinel-2-l2a", "SENTINEL-2-L1C"))), (F.col("user_id") % 4).cast("int"))
    area = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("POINT("), F.col("event_id").cast("string"), F.lit(" 1)")))
    return e.select("event_id", rules.catalogue_filter(kind, area, F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100), day, day).alias("filter"))


@query("""SELECT event_id FROM events WHERE user_id % 2 = 1 AND event_type LIKE '%i%' AND value <= 60 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def catalogue_answers(spark, d):
    p = _read(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 1, "SENTINEL-2").otherwise("SENTINEL-1").alias("collection"), F.col("value").alias("cloud"), F.col("ts").alias("start"))
    return rules.answers(p, "sentinel-2", "i", 60.0, "2024-01-05", "2024-01-20").select("event_id")


@query("""SELECT path, name FROM scenes WHERE substr(name, 12, 8) IN ('20240103', '20240117') AND substr(name, 1, 3) IN ('S2A', 'S2C') AND substr(name, 39, 6) <> 'T49SDE' AND name NOT LIKE '%.SAFE%'""", "scenes")
def wanted_scenes(spark, d):
    s = scenes.parsed(view(spark, d, "scenes").where("name not like '%.SAFE%'"))
    return rules.kept_scenes(s, ["2024-01-03", "20240117"], ["s2a", "S2C"], ["T49SCD", "t49sce", "T49SDD"]).select("path", "name")


@query("""SELECT n_name AS county_name, CAST(150100 + n_nationkey AS VARCHAR) AS county_code FROM nation WHERE n_regionkey IN (1, 3) AND (n_nationkey % 7 = 2 OR n_name LIKE 'I%')""")
def wanted_regions(spark, d):
    """Cities by name without their ending, then counties by name or code."""
    n = _read(spark, d, "nation").withColumn("city_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("市")))
    cities = rules.kept_cities(n, spark.createDataFrame([("R1",), (" R3盟 ",), ("R9",)], "name string"))
    words = n.select(F.when(F.col("n_nationkey") % 7 == 2, (150100 + F.col("n_nationkey")).cast("string")).otherwise(F.when(F.col("n_name").like("I%"), F.col("n_name"))).alias("name")).where("name is not null")
    return rules.kept_counties(cities.select(F.col("n_name").alias("county_name"), (150100 + F.col("n_nationkey")).cast("string").alias("county_code")), words)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 's' || c_nationkey || '.shp' WHEN c_custkey % 4 = 1 THEN 'region_' || lpad(CAST(c_custkey + 1 AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey + 1 AS VARCHAR))) AS INTEGER), '0') ELSE c_name END AS name FROM customer""")
def region_row_names(spark, d):
    """The field is found by its values; blank names fall back on the file, then on the number."""
    k = F.col("c_custkey") % 4
    c = _read(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("area_name"), F.when(k == 0, " none ").when(k == 1, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.when(k != 1, F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit(".shp"))).alias("_source_file"))
    return c.select("c_custkey", rules.row_names(c, rules.name_field(c, rules.ROI_FIELDS), "c_custkey").alias("name"))


@query("""SELECT arg_min(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 9 = 4""")
def region_of_interest(spark, d):
    c = _read(spark, d, "customer").select("c_custkey", F.lit("None").alias("name"), F.when(F.col("c_custkey") % 9 == 4, F.col("c_name")).otherwise("  ").alias("NAME_"))
    return rules.roi_name(c.withColumnRenamed("NAME_", "名称"), "stem", "c_custkey")


@query("""SELECT p_partkey, p_size % 5 <> 0 AS inside, p_size % 4 <> 1 AND p_size % 3 <> 0 AS loose FROM part""")
def guarded_paths(spark, d):
    p, s = _read(spark, d, "part"), F.col("p_size")
    inside = rules.within(F.concat(F.when(s % 5 == 0, "/data/./a/../../database/").when(s % 5 == 1, "\\data\\x\\..\\").otherwise("/data//a/"), F.col("p_partkey").cast("string")), "/data")
    files = p.select("p_partkey", F.concat(F.lit("/in/"), F.when(s % 4 == 1, "").when(s % 3 == 0, F.concat("p_brand", F.lit("镇/"))).otherwise("d/e/"), F.lit("a.tif")).alias("path"))
    kept = rules.loose_files(files, "/in").select("p_partkey", F.lit(True).alias("loose"))
    return p.select("p_partkey", inside.alias("inside")).join(kept, "p_partkey", "left").withColumn("loose", F.coalesce("loose", F.lit(False)))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'input is empty' WHEN c_custkey % 6 = 1 THEN 'output is empty' WHEN c_custkey % 7 = 0 THEN 'workers is no whole number' WHEN c_nationkey * 2 NOT BETWEEN 1 AND 32 THEN 'workers is not from 1 to 32' WHEN c_custkey % 11 = 3 THEN 'no city' WHEN c_custkey % 13 = 5 THEN 'unknown city X' || c_custkey END AS error FROM customer""")
def checked_run_configs(spark, d):
    k = F.col("c_custkey")
    cities = F.when(k % 11 == 3, F.array().cast("array<string>")).when(k % 13 == 5, F.array(F.lit("ASIA"), F.concat(F.lit("X"), k.cast("string")))).otherwise(F.array(F.lit("ASIA"), F.lit("EUROPE")))
    c = _read(spark, d, "customer").select(k.alias("id"), F.when(k % 6 == 0, " ").otherwise("/in").alias("input"), F.when(k % 6 != 1, "/out").alias("output"), F.when(k % 7 == 0, "four").otherwise(F.concat(F.lit(" "), (F.col("c_nationkey") * 2).cast("string"))).alias("workers"), cities.alias("cities"))
    return rules.checked_configs(c, _read(spark, d, "region").select(F.col("r_name").alias("city_name"))).select("id", "error")


@query("""SELECT event_id FROM events WHERE event_type = 'click' OR value > 95 OR user_id % 10 >= 7""")
def routed_log_rows(spark, d):
    e = _read(spark, d, "events").select("event_id", F.col("event_type").alias("logger"), (F.col("value") > 95).alias("final"), ((F.col("user_id") % 10 - 4) * 10).alias("level"))
    return rules.routed(e, "click").select("event_id")


@query("""SELECT c_custkey, least(greatest(c_nationkey, 1), a * 3) AS planned, CAST(ceil(least(greatest(c_nationkey, 1), a * 3) / 3.0) AS INTEGER) AS clients, CAST(least(greatest(c_nationkey, 1), a * 3) - (ceil(least(greatest(c_nationkey, 1), a * 3) / 3.0) - 1) * 3 AS INTEGER) AS last FROM (SELECT c_custkey, c_nationkey, CAST(1 + c_custkey % 5 AS INTEGER) AS a FROM customer)""")
def planned_workers(spark, d):
    return _read(spark, d, "customer").select("c_custkey", rules.planned_workers(F.col("c_nationkey"), (1 + F.col("c_custkey") % 5).cast("int")).alias("p")).select("c_custkey", "p.*")


@query("""SELECT p_partkey, reason, destination, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(path, '\\.zip$', '.txt') END AS side, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(destination, '\\.zip$', '.txt') END AS side_destination FROM (
SELECT p_partkey, path, reason, '/skip/' || CASE WHEN n = 1 THEN rel ELSE regexp_replace(rel, '\\.zip$', '') || '_重复' || CAST(n - 1 AS VARCHAR) || '.zip' END AS destination FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY path) AS n FROM (
SELECT p_partkey, path, 'no MSIL2A product: ' || p_name AS reason, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '.zip' ELSE substr(path, 5) END AS rel FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN '/old/' || p_partkey || '/' ELSE '/in/' || p_size || '/' || p_partkey || '/' END || p_brand || '.zip' AS path FROM part WHERE p_partkey % 3 <> 0))))""")
def rejected_archives(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, F.concat(F.lit("/old/"), k.cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("/in/"), F.col("p_size").cast("string"), F.lit("/"), k.cast("string"), F.lit("/"))), "p_brand", F.lit(".zip"))
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit("_msil2a_"))).otherwise(F.col("p_name"))
    p = _read(spark, d, "part").select("p_partkey", path.alias("path"), rules.product_level(name).alias("reason"), (k % 2 == 0).alias("has_txt"))
    return rules.rejected(p, "/in", "/skip").join(p.select("p_partkey", "path"), "path").select("p_partkey", "reason", "destination", "side", "side_destination")


@query("""SELECT archive, city, CASE WHEN v THEN 'existing' WHEN NOT any_v AND city = first THEN 'extract' ELSE 'copy' END AS action, CASE WHEN v THEN NULL WHEN any_v THEN donor WHEN city = first THEN NULL ELSE first END AS source FROM (
SELECT archive, city, v, bool_or(v) OVER w AS any_v, min(CASE WHEN v THEN city END) OVER w AS donor, min(city) OVER w AS first FROM (SELECT DISTINCT o_custkey AS archive, o_orderpriority AS city, o_custkey % 3 = 0 AND o_orderpriority IN ('3-MEDIUM', '5-LOW') AS v FROM orders) WINDOW w AS (PARTITION BY archive))""")
def fanned_out_archives(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("archive"), F.col("o_orderpriority").alias("city"))
    have = o.withColumn("valid", (F.col("archive") % 3 == 0) & F.col("city").isin("3-MEDIUM", "5-LOW"))
    return rules.fanned_out(o.groupBy("archive").agg(F.collect_list("city").alias("cities")), have)


@query("""SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS INTEGER) AS round FROM orders""")
def retried_downloads(spark, d):
    """An order fails as often as its key says, then is done."""
    o = _read(spark, d, "orders").select("o_orderkey")
    return rules.in_rounds(o, "o_orderkey", lambda left, n: left.withColumn("ok", F.col("o_orderkey") % 4 < n))


@query("""SELECT l_returnflag, CASE WHEN count_if(l_discount > 0.09) = 0 THEN round(sum(l_extendedprice), 2) END AS total_m2, count(*) AS files, CAST(count_if(l_discount > 0.09) AS BIGINT) AS failed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def whole_total(spark, d):
    rows = _read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_extendedprice").alias("area_m2"), F.when(F.col("l_discount") > 0.09, "cut short").alias("error"))
    return rules.whole_or_nothing(rows).select(F.lit("R").alias("l_returnflag"), F.round("total_m2", 2).alias("total_m2"), "files", "failed")


@query("""SELECT o_orderpriority, '中稻 0809 地块掩膜面积对比报告' || chr(10) || repeat('=', 42) || chr(10) || '合并面要素数: ' || format('{:,}', n) || chr(10) || CASE WHEN s > 0 THEN '跳过的空/非面要素数: ' || format('{:,}', s) || chr(10) ELSE '' END || '栅格化规则: 8×8 超采样，按覆盖率排序并约束总面积' || chr(10) || '标称分辨率: 10 m × 10 m' || chr(10) || chr(10)
|| '矢量净覆盖面积（重叠只算一次）: ' || format('{:,.3f}', u) || ' m²' || chr(10) || 'TIFF 值为 255 区域面积: ' || format('{:,.3f}', r) || ' m²' || chr(10) || '面积差（TIFF - 矢量）: ' || format('{:,.3f}', r - u) || ' m²' || chr(10) || '差异比例（相对矢量）: ' || CASE WHEN u > 0 THEN format('{:.6f}', abs(r - u) / u * 100) ELSE 'nan' END || '%' || chr(10) || chr(10)
|| '说明：面积均在内存中转换到 Albers 等面积投影计算；矢量重叠部分只算一次。' || chr(10) AS report FROM (SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'P' AND o_orderpriority LIKE '1%') AS s, CAST(sum(o_custkey % 512) AS DOUBLE) / 8 * CASE WHEN o_orderpriority LIKE '2%' THEN 0 ELSE 1 END AS u, CAST(sum(o_orderkey % 1024) AS DOUBLE) / 16 AS r FROM orders GROUP BY 1)""")
def comparison_reports(spark, d):
    """A report for each class of rows."""
    low = F.col("o_orderpriority").like("2%")
    s = _read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("features"), F.count_if((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").like("1%")).alias("skipped"), (F.sum(F.col("o_custkey") % 512).cast("double") / 8).alias("unique_m2"), (F.sum(F.col("o_orderkey") % 1024).cast("double") / 16).alias("raster_m2"))
    s = s.withColumn("unique_m2", F.when(low, 0.0).otherwise(F.col("unique_m2")))
    return reports.comparison_report(s, keep=["o_orderpriority"])
