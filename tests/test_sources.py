"""Readers over small files written here."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import names as N
from terrafold.functions import numbers as M
from terrafold.sources import shapefile as S
from terrafold.sources import texts

SQUARE = np.array([[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]], float)
HOLE = np.array([[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]], float)


def dbf(rows):
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 + 1, 1 + 6)
    field = b"class".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14)
    return head + field + b"\r" + b"".join(b" " + r.encode().ljust(6) for r in rows) + b"\x1a"


@pytest.fixture()
def folder(tmp_path):
    shp, shx = S.layer([[SQUARE, HOLE], None, [SQUARE + 5]])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One.SHP").write_bytes(shp)
    (tmp_path / "a" / "One.shx").write_bytes(shx)
    (tmp_path / "a" / "One.dbf").write_bytes(dbf(["rice", "", "corn"]))
    (tmp_path / "bad.shp").write_bytes(b"no layer")
    return str(tmp_path)


def test_features(spark, folder):
    rows = S.features(spark, folder).withColumn("area", G.polygon_area(F.col("rings"))).orderBy("source_file", "feature_no").collect()
    assert [(r.kind, r.area) for r in rows] == [(5, 96.0), (0, 0.0), (5, 100.0), (-1, 0.0)]
    assert [(r.attributes or {}).get("class") for r in rows[:3]] == ["rice", None, "corn"]
    assert rows[3].attributes["error"] == "not a shapefile"
    assert S.feature_counts(spark, folder).first().features == 3
    assert S.listing(spark, folder).count() == 2


def test_moved(spark, folder, tmp_path):
    (tmp_path / "bad.shp").unlink()
    content = S.moved_layers(spark, folder, 1.5, -2).first().content
    kinds = [k for _, k, _, _ in S.records(content)]
    assert kinds == [5, 0, 5]
    begin = next(S.records(content))[2]
    assert np.array_equal(S.rings(content, begin)[0], SQUARE + (1.5, -2))
    assert struct.unpack_from("<4d", content, 36) == (1.5, -2, 16.5, 13)


@pytest.mark.parametrize("cut", [99, 104, 150])
def test_cut_short(cut):
    with pytest.raises(S.BadLayer):
        list(S.records(S.layer([[SQUARE]])[0][:cut]))


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿\"/mnt/甲.tif\"\r\n\r\n# no\r\n b \r\n".encode())
    (tmp_path / "b.txt").write_bytes("乙镇\n".encode("gb18030"))
    got = texts.names(texts.lines(spark, str(tmp_path))).orderBy("file", "line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(1, "/mnt/甲.tif"), (4, "b"), (1, "乙镇")]


def test_control_points(spark, tmp_path):
    for name, t in {"a": "1,2；3.5 4e1", "b": "1 2 3", "c": "1 2 3 x", "d": "1\n2\n3\n4"}.items():
        (tmp_path / f"{name}.txt").write_text(t)
    rows = texts.control_points(texts.lines(spark, str(tmp_path))).orderBy("file").collect()
    assert [(r.dx, r.dy) for r in rows] == [(2.5, 38.0), (None, None), (None, None), (2.0, 2.0)]


def test_products_and_archives(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"value":[{"Id":"1","Name":"S2A_x_T49SCD_y","Attributes":[]},{"Id":"2","Name":"n","Attributes":[{"Name":"tileId","Value":"49SCE"}]},{"Id":"3","Name":"n"}]}')
    assert [r.tile for r in texts.products(spark, str(tmp_path / "p.json")).orderBy("id").collect()] == ["T49SCD", "49SCE", "未知"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for b in ("B02", "B03", "B8A"):
            z.writestr(f"g/IMG_DATA/R10m/x_{b}_10m.jp2", "")
    (tmp_path / "bad.zip").write_bytes(b"x")
    members = texts.band_members(spark, str(tmp_path))
    missing = {r.path.rsplit("/", 1)[1]: sorted(r.missing) for r in texts.missing_bands(members).collect()}
    assert missing == {"z.zip": ["B04", "B08"], "bad.zip": ["B02", "B03", "B04", "B08"]}


def test_names(spark):
    df = spark.createDataFrame([("S2A_MSIL2A_20240102T030405_N0510_R075_T49SCD_20240131T000000.SAFE", " 阿拉善盟 ", "150102.0", "a:b?. ", "甲镇边界.shp", 5400.5)], "p string, r string, c string, s string, t string, e double")
    r = df.select(N.product(F.col("p")).alias("p"), N.region_name(F.col("r")).alias("r"), N.numeric_code(F.col("c"), 6).alias("c"), N.numeric_code(F.col("c"), 7).alias("c7"), N.safe_name(F.col("s")).alias("s"), N.town(F.col("t")).alias("t"), N.elapsed(F.col("e")).alias("e"), N.without_safe(F.col("p")).alias("w"), N.sensing_time(N.product(F.col("p"))["sensing"]).alias("ts"), N.extension(F.lit("a/b.SHP.XML")).alias("x"), N.split_list(F.lit("a，b, c")).alias("l")).first()
    assert (r.p.tile, r.p.level, str(r.ts)) == ("T49SCD", "MSIL2A", "2024-01-02 03:04:05")
    assert (r.r, r.c, r.c7, r.s, r.t, r.e, r.x, r.l) == ("阿拉善", "150102", "", "a_b_", "甲镇", "1h30m00s", ".shp.xml", ["a", "b", "c"])
    assert not r.w.endswith(".SAFE")


def test_projection(spark):
    x, y = G.Albers().forward(F.col("lon"), F.col("lat"))
    b = G.densified_bounds(F.lit(104.0), F.lit(30.0), F.lit(106.0), F.lit(31.0), G.Albers().forward)
    r = spark.createDataFrame([(105.0, 0.0), (105.0, 35.0), (110.0, 40.0)], "lon double, lat double").select(x.alias("x"), y.alias("y"), b.alias("b"), G.utm_zone(F.col("lon")).alias("z"), M.nice_step(F.lit(730.0)).alias("n")).collect()
    assert abs(r[0].x) < 1e-6 and abs(r[0].y) < 1e-6 and abs(r[1].x) < 1e-6
    assert 4.0e5 < r[2].x < 4.5e5
    assert abs(r[0].b.maxx + r[0].b.minx) < 1e-6 and r[0].b.maxy > r[0].b.miny
    assert r[2].z == 49 and r[0].n == 200


def test_equal_area(spark):
    """A small cell keeps its area on the ellipsoid."""
    step, lat = 0.01, 35.0
    cell = G.box(F.lit(100.0), F.lit(lat - step / 2), F.lit(100.0 + step), F.lit(lat + step / 2))
    ring = F.transform(cell, lambda p: F.struct(*(c.alias(n) for c, n in zip(G.Albers().forward(p["x"], p["y"]), "xy", strict=True))))
    got = spark.range(1).select(F.abs(G.ring_area(ring)).alias("a")).first().a
    f = 1 / 298.257223563
    e2, s = f * (2 - f), np.sin(np.radians(lat))
    expected = 6378137.0**2 * (1 - e2) / (1 - e2 * s * s) ** 2 * np.cos(np.radians(lat)) * np.radians(step) ** 2
    assert abs(got / expected - 1) < 1e-6
