"""Views over the shared tables that stand for parcels, regions, scenes, pixels, file lists and task logs.

The SQL is valid in Spark and elsewhere; queries use it through ``view``, and their checking SQL as ``WITH``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "regions": """SELECT CAST(1501 + r AS STRING) AS city_code, CAST((1501 + r)*100 + 1 + rn AS STRING) AS county_code, n_name AS county_name,
  CAST(1000*r + 200*rn AS DOUBLE) AS minx, CAST(0 AS DOUBLE) AS miny, CAST(1000*r + 200*rn + 200 AS DOUBLE) AS maxx, CAST(1000 AS DOUBLE) AS maxy
  FROM (SELECT n_name, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS rn FROM nation) t""",
    "cities": """SELECT CAST(1501 + r_regionkey AS STRING) AS city_code, CAST(1000*r_regionkey AS DOUBLE) AS minx, CAST(0 AS DOUBLE) AS miny,
  CAST(1000*r_regionkey + 1000 AS DOUBLE) AS maxx, CAST(1000 AS DOUBLE) AS maxy FROM region""",
    "parcels": """SELECT l_orderkey*10 + l_linenumber AS parcel_id, concat('f', CAST(l_orderkey % 40 AS STRING), '.shp') AS source_file, l_returnflag AS class_code,
  CAST((l_orderkey*37 + l_linenumber*11) % 5000 AS DOUBLE) AS minx, CAST((l_partkey*53) % 1000 AS DOUBLE) AS miny,
  CAST((l_orderkey*37 + l_linenumber*11) % 5000 + 1 + floor(l_quantity) AS DOUBLE) AS maxx, CAST((l_partkey*53) % 1000 + 1 + l_suppkey % 20 AS DOUBLE) AS maxy FROM lineitem""",
    "fields": """SELECT o_orderkey AS parcel_id, CAST((o_orderkey*37) % 5000 AS DOUBLE) AS minx, CAST((o_custkey*53) % 1000 AS DOUBLE) AS miny,
  CAST((o_orderkey*37) % 5000 + 5 + o_orderkey % 30 AS DOUBLE) AS maxx, CAST((o_custkey*53) % 1000 + 5 + o_custkey % 20 AS DOUBLE) AS maxy FROM orders""",
    "pixels": """SELECT CAST(o_custkey % 6 AS INT) AS raster_id, CAST(floor(o_orderkey / 128) AS INT) AS row, CAST(o_orderkey % 128 AS INT) AS col, 1 AS band,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE floor(o_totalprice) % 4000 END AS INT) AS value FROM orders""",
    "scenes": """SELECT concat('/in/', CAST(event_id AS STRING), '.tif') AS path,
  concat('S2', CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '_MSIL2A_202401', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), 'T0', CAST(event_id % 10 AS STRING), '3015_N0510_R075_T49S', CASE user_id % 4 WHEN 0 THEN 'CD' WHEN 1 THEN 'CE' WHEN 2 THEN 'DD' ELSE 'DE' END, '_20240131T000000', CASE WHEN event_id % 7 = 0 THEN '.SAFE' ELSE '.tif' END) AS name,
  CAST((event_id*97) % 4900 AS DOUBLE) AS minx, CAST((user_id*31) % 900 AS DOUBLE) AS miny, CAST((event_id*97) % 4900 + 40 + user_id % 60 AS DOUBLE) AS maxx, CAST((user_id*31) % 900 + 40 + event_id % 60 AS DOUBLE) AS maxy FROM events""",
    "files_left": """SELECT concat('Dir', CAST(p_size AS STRING), '/', CAST(p_partkey AS STRING), '.TIF') AS rel_path, CAST(p_size * 10 AS BIGINT) AS length, p_type AS hash FROM part WHERE p_partkey % 5 <> 0""",
    "files_right": """SELECT concat('dir', CAST(p_size AS STRING), '/', CAST(p_partkey AS STRING), '.tif') AS rel_path, CAST(p_size * 10 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length,
  CASE WHEN p_partkey % 13 = 0 THEN 'changed' ELSE p_type END AS hash FROM part WHERE p_partkey % 7 <> 0""",
    "files": """SELECT p_partkey, concat('/d', CAST(p_size % 9 AS STRING), '/', CAST(p_partkey AS STRING), '/', p_brand, CAST(p_size AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tif' ELSE '.ovr' END) AS path,
  concat(p_brand, CAST(p_size AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tif' ELSE '.ovr' END) AS name, CAST(p_size AS BIGINT) AS length FROM part""",
    "shape_points": """SELECT o_orderkey AS parcel_id, o_orderstatus AS class_code, ring, pos, CAST((o_orderkey*37) % 5000 + px * (1 + o_orderkey % 5) AS DOUBLE) AS x, CAST((o_custkey*53) % 1000 + py * (1 + o_orderkey % 5) AS DOUBLE) AS y
  FROM orders JOIN (VALUES (0,0,0,0,0), (0,0,1,4,0), (0,0,2,4,4), (0,0,3,0,4), (1,0,0,0,0), (1,0,1,4,0), (1,0,2,0,4),
  (2,0,0,0,0), (2,0,1,4,0), (2,0,2,4,1), (2,0,3,1,1), (2,0,4,1,4), (2,0,5,0,4), (3,0,0,0,0), (3,0,1,4,0), (3,0,2,4,4), (3,0,3,0,4), (3,1,0,2,1), (3,1,1,3,2), (3,1,2,2,3), (3,1,3,1,2),
  (4,0,0,0,0), (4,0,1,4,4), (4,0,2,4,0), (4,0,3,0,4), (5,0,0,0,0), (5,0,1,4,0), (5,0,2,4,2), (5,0,3,6,2), (5,0,4,4,2), (5,0,5,4,4), (5,0,6,0,4),
  (6,0,0,0,0), (6,0,1,3,0), (6,0,2,3,3), (6,0,3,0,3), (6,1,0,1,1), (6,1,1,4,1), (6,1,2,4,4), (6,1,3,1,4)) AS t(shape, ring, pos, px, py) ON o_orderkey % 7 = shape""",
    "zone_points": """SELECT CAST(1501 + r_regionkey AS STRING) AS city_code, 0 AS ring, pos, CAST(1000*r_regionkey + px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y
  FROM region JOIN (VALUES (0,400,0), (1,600,0), (2,1000,400), (3,1000,600), (4,600,1000), (5,500,900), (6,400,1000), (7,0,600), (8,0,400)) AS t(pos, px, py) ON true""",
    "task_events": """SELECT event_id, user_id AS task_id, ts, event_type AS type, value FROM events""",
}
_USES = {n: sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)", v)) - {"t"}) for n, v in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _USES[name]}
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def using(*names: str) -> str:
    """The WITH clause for these views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"
