"""Boundary layers written here: checks, codes, projections, dissolving, listings."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions.geometry import Albers
from terrafold.sources import boundaries as B
from terrafold.sources import layers as L
from terrafold.sources import shapefile as S

RINGS = "layer string, feature_no long, rings array<array<struct<x:double,y:double>>>, `市名称` string, code string"
WGS, ALBERS = 'GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298.25]],AUTHORITY["EPSG","4326"]]', 'PROJCS["Own", GEOGCS["x"], PROJECTION["Albers"]]'


def box(x, y, w=1.0, h=1.0):
    x, y = float(x), float(y)
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [("city", 0, box(110, 40), "呼和市", "1501.0"), ("city", 1, box(111, 40), "呼和市", "1501"), ("city", 2, box(113, 40), " none ", "1502"), ("city", 3, box(114, 40), "包头盟", "x"), ("city", 4, None, "无", "1504")]
    df = spark.createDataFrame(rows, RINGS)
    L.write_layers(df, str(tmp_path), crs=WGS)
    L.write_layers(df.where("feature_no = 4").withColumn("layer", F.lit("sub/empty")), str(tmp_path), crs=WGS)
    L.write_layers(df.withColumn("layer", F.lit("sub/bare")).drop("code"), str(tmp_path))
    (tmp_path / "bad.shp").write_bytes(b"x" * 200)
    (tmp_path / "sub" / "a.GeoJSON").write_text("{}")
    (tmp_path / "sub" / ".hidden.json").write_text("{}")
    return str(tmp_path)


def test_checks(spark, folder):
    f, crs = S.features(spark, folder), B.systems(spark, folder)
    wanted = spark.createDataFrame([(f"{folder}/City",), (f"{folder}/none",)], "layer string")
    got = {r.layer.removeprefix(folder.lower() + "/"): (r.features, r.error) for r in B.layer_checks(f, crs, ["市名称", "code"], wanted).collect()}
    assert got == {"city": (4, None), "sub/empty": (0, "empty"), "sub/bare": (4, "field code is missing"), "bad": (0, "not a shapefile"), "none": (0, "missing")}
    assert dict((r.layer.rsplit("/", 1)[1], r.error) for r in B.layer_checks(f, crs, ["市名称"]).collect())["bare"] == "no system"
    assert {(r.name, r.albers) for r in crs.collect()} == {("WGS 84", False)}


def test_boundaries(spark, folder):
    f = S.features(spark, folder).where("source_file like '%city.shp'")
    assert sorted((r.feature_no, r.name, r.plain_name, r.code) for r in B.boundaries(f, "市名称", "code").collect()) == [(0, "呼和市", "呼和", "1501"), (1, "呼和市", "呼和", "1501")]
    assert [r.plain_name for r in B.boundaries(f, "市名称").orderBy("feature_no").collect()] == ["呼和", "呼和", "包头"]
    assert [r["市名称"] for r in B.attributes(f, "市名称").orderBy("feature_no").collect()] == ["呼和市", "呼和市", None, "包头盟", "无"]
    flat = B.dissolved(B.boundaries(f, "市名称", "code"), ["code", "plain_name"], 1.0).collect()
    assert [(r.code, r.hole, r.area, len(r.ring)) for r in flat] == [("1501", False, 2.0, 5)]
    albers = Albers()
    one = B.dissolved(B.boundaries(f, "市名称", "code"), ["code"], 100000.0, albers).collect()
    # two degrees by one at 40 to 41 degrees north: an equal-area projection of corners gives nearly the cell's area
    assert len(one) == 1 and math.isclose(one[0].area, 2 * 111_000 * 85_000 * 0.9945, rel_tol=0.01)


def test_in_degrees(spark):
    albers = Albers()
    there = spark.createDataFrame([("a", box(110, 40)), ("b", box(110, 40))], "layer string, rings array<array<struct<x:double,y:double>>>")
    from terrafold.functions.geometry import reprojected

    mixed = there.withColumn("rings", F.when(F.col("layer") == "a", reprojected(F.col("rings"), albers.forward)).otherwise(F.col("rings")))
    crs = spark.createDataFrame([("a", ALBERS, True), ("b", WGS, False)], "layer string, crs string, albers boolean")
    rows = {r.layer: r.rings for r in B.in_degrees(mixed, crs, albers).collect()}
    assert all(math.isclose(p.x, q.x, abs_tol=1e-9) and math.isclose(p.y, q.y, abs_tol=1e-9) for p, q in zip(rows["a"][0], rows["b"][0], strict=True))


def test_systems(spark):
    cases = [(WGS, WGS.replace(",AUTHORITY", ", AXIS[\"Lat\",NORTH], AUTHORITY").lower(), True), (WGS, ALBERS, False), (None, WGS, False), (ALBERS, ALBERS.replace(" ", ""), True)]
    df = spark.createDataFrame(cases, "a string, b string, same boolean")
    assert [r.got == r.same for r in df.withColumn("got", B.same_system(F.col("a"), F.col("b"))).collect()] == [True] * 4


def test_listings(spark, folder):
    names = lambda df: [r.name for r in df.collect()]
    assert names(B.vectors(spark, folder)) == ["bad.shp", "city.shp", "a.GeoJSON", "bare.shp", "empty.shp"]
    assert [r.folder for r in B.vectors(spark, folder).collect()] == [None, None, "sub", "sub", "sub"]
    assert names(B.files(spark, folder, [".shp"], recursive=False)) == ["bad.shp", "city.shp"]
    assert names(B.files(spark, folder, [".shp"], without=folder + "/sub", limit=1)) == ["bad.shp"]
    assert names(B.files(spark, folder + "/city.shp", [".shp"])) == ["city.shp"]
    with pytest.raises(Exception, match="no layers here"):
        B.refused(B.files(spark, folder, [".zip"]), "no layers here").collect()
    assert names(B.refused(B.files(spark, folder, [".json"]).union(B.vectors(spark, folder)), "none")) == names(B.vectors(spark, folder))


def test_roi(spark, folder, tmp_path):
    assert [(r.area, r.hole) for r in B.roi(spark, box=(1, 2, 4, 8)).collect()] == [(18.0, False)]
    assert sorted(round(r.area, 9) for r in B.roi(spark, folder + "/city.shp").collect()) == [2.0, 2.0]
    with pytest.raises(Exception, match="is empty"):
        B.roi(spark, folder + "/sub/empty.shp").collect()
    with pytest.raises(ValueError):
        B.roi(spark)
