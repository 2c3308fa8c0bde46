"""Layers written and read again; failures leave the folder as it was."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.sources import layers as L
from terrafold.sources import shapefile as S

SCHEMA = "layer string, feature_no long, rings array<array<struct<x:double,y:double>>>, Name string, class long, size double, good boolean"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]


def rows():
    out = [(f"{'ab'[k % 2]}/layer{k % 3}", k, [SQUARE, HOLE] if k % 4 else None, "名称" * 60 if k == 7 else f"n{k}", k * 10**12, k / 3, k % 2 == 0) for k in range(30)]
    return [*out, ("a/layer0", 40, [[], SQUARE + SQUARE[:1]], None, None, None, None)]


def state(folder):
    return {str(p.relative_to(folder)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*") if p.is_file()}


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    L.write_layers(spark.createDataFrame(rows(), SCHEMA).repartition(7), folder, crs="PROJCS[]")
    got = S.features(spark, folder).withColumn("area", G.polygon_area(F.col("rings"))).collect()
    assert len(got) == 31 and not list(Path(folder).rglob(".*"))
    by = {(g.source_file.split("out/")[1], g.feature_no): g for g in got}
    want: dict = {}
    for layer, no, rings, name, cls, size, good in sorted(rows(), key=lambda r: r[1]):
        k = want.setdefault(layer, 0)
        want[layer] += 1
        g = by[f"{layer}.shp", k]
        assert g.area == (0 if rings is None else 16 if rings[0] == [] else 15) and (g.rings is None) == (rings is None)
        a = g.attributes
        assert a["class"] == (None if cls is None else str(cls)) and (size is None or abs(float(a["size"]) - size) < 1e-14) and a["good"] == (None if good is None else "TF"[not good])
        assert a["Name"] == name or (name and a["Name"] == name[:84])
    assert {p.suffix for p in Path(folder).rglob("layer*")} == {".shp", ".shx", ".dbf", ".prj", ".cpg"}
    content = (Path(folder) / "b/layer1.shp").read_bytes()
    begin = next(b for _, k, b, _ in S.records(content) if k == 5)
    outer, hole = S.rings(content, begin)
    turn = lambda r: float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())
    assert turn(outer) < 0 < turn(hole)
    assert sum(r.features for r in S.feature_counts(spark, folder).collect()) == 31


def test_refused(spark, tmp_path):
    """Layers that are there, empty tables, split layers, failing tasks and paths that lead out change nothing."""
    folder = tmp_path / "out"
    df = spark.createDataFrame(rows(), SCHEMA)
    L.write_layers(df.where("feature_no < 20"), str(folder))
    (folder / "a" / "layer0.qix").write_bytes(b"index")
    before = state(folder)
    broken = df.withColumn("class", F.when(F.col("feature_no") == 29, F.raise_error(F.lit("broken row"))).otherwise(F.col("class")))
    two = df.repartition(4).write.format("polygon_layers").option("replace", "true").mode("append")
    for fail, why in [(lambda: L.write_layers(df, str(folder)), "there already"), (lambda: L.write_layers(broken, str(folder), overwrite=True), "broken row"), (lambda: two.save(str(folder)), "two tasks"), (lambda: L.write_layers(df.where("false"), str(folder), some=True), "nothing to write"), (lambda: L.write_layers(df.withColumn("layer", F.lit("../../x")), str(folder), overwrite=True), "outside")]:
        with pytest.raises(Exception, match=why):
            fail()
        assert state(folder) == before, why
    L.write_layers(df.where("layer = 'a/layer0'"), str(folder), overwrite=True)
    assert not (folder / "a" / "layer0.qix").exists() and state(folder)["b/layer1.shp"] == before["b/layer1.shp"]
    L.write_layers(df.where("false"), str(tmp_path / "none"))


def test_rolled_back(tmp_path):
    """A failure in the middle of the swap brings the old files back."""
    for name in ("one", "two"):
        f = L.LayerFile(tmp_path / f"{name}.shp", [(b"v", b"N", 18, 0)], None)
        f.add(None, [1])
        f.close()
    before = state(tmp_path)
    staged = []
    for name in ("one", "two"):
        f = L.LayerFile(tmp_path / f".{name}.t-0-building.shp", [(b"v", b"N", 18, 0)], None)
        f.add([[{"x": x, "y": y} for x, y in SQUARE]], [2])
        f.add(None, [3])
        staged.append((str(tmp_path / f".{name}.t-0-building.shp"), str(tmp_path / f"{name}.shp"), f.close()))
    with pytest.MonkeyPatch.context() as m:
        real, calls = L.counted, []

        def counted(shp):
            calls.append(shp)
            if shp.name == "two.shp":
                raise OSError("lost")
            return real(shp)

        m.setattr(L, "counted", counted)
        with pytest.raises(OSError):
            L.put_in_place(staged, "t", True)
    after = state(tmp_path)
    assert {k: v for k, v in after.items() if not k.startswith(".")} == before


def test_rewrite_class(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame(rows(), SCHEMA)
    L.write_layers(df.withColumnRenamed("class", "CLASS"), str(source))
    L.write_layers(df.drop("class").withColumn("layer", F.concat("layer", F.lit("x"))), str(source))
    L.rewrite_class(spark, str(source), str(target), 5)
    old, new = ({(g.source_file.split("/in/")[-1].split("/out/")[-1], g.feature_no): g for g in S.features(spark, str(p)).collect()} for p in (source, target))
    assert old.keys() == new.keys()
    for k, g in new.items():
        own = "class" if k[0].endswith("x.shp") else "CLASS"
        assert g.attributes.pop(own) == "5" and g.rings == old[k].rings
        assert g.attributes == {n: v for n, v in old[k].attributes.items() if n != own}
    before = state(target)
    L.rewrite_class(spark, str(source), str(source), 5, overwrite=True)
    assert state(source) == before
    (source / "a" / "layer0.dbf").write_bytes(L.dbf_head([(b"v", b"N", 18, 0)], 0) + b"\x1a")
    before = state(source)
    with pytest.raises(Exception, match="shapes, but"):
        L.rewrite_class(spark, str(source), str(source), 6, overwrite=True)
    assert state(source) == before


def test_fields():
    assert L.class_field(["a", "Class", "CLASS"]) == "Class" and L.class_field([]) == "class"
    assert len(L._cell(1e300, b"N", 24, 15)) == 24 and L._cell("é" * 200, b"C", 254, 0).decode().strip() == "é" * 127
    assert float(L._cell(-1e22 / 3, b"N", 24, 15)) == pytest.approx(-1e22 / 3)
    assert np.array_equal(L.directed([np.array([*SQUARE, SQUARE[0]])])[0], np.array([*SQUARE, SQUARE[0]])[::-1])
