"""Previews of files written here, and a layer's naming field."""

import json

import pytest

from terrafold.operators import rules
from terrafold.sources import previews as P


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffname,\"x,y\"\r\n甲,1\r\n\"乙\n\",2\r\n".encode())
    (tmp_path / "b.CSV").write_bytes("镇,乡\n一,二\n".encode("gb18030"))
    (tmp_path / "c.csv").write_text("n\n" + "\n".join(map(str, range(700))))
    (tmp_path / "d.csv").write_text("n\n" + "\n".join(map(str, range(499))))
    got = {r.name: r for r in P.tables(spark, str(tmp_path)).collect()}
    assert (got["a.csv"].headers, got["a.csv"].rows, got["a.csv"].truncated) == (["name", "x,y"], [["甲", "1"], ["乙\n", "2"]], False)
    assert got["b.CSV"].headers == ["镇", "乡"] and len(got["c.csv"].rows) == 500 and got["c.csv"].truncated and not got["d.csv"].truncated


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b":[1,"甲"]}')
    (tmp_path / "b.json").write_text("{no json")
    (tmp_path / "c.json").write_text(json.dumps(["x" * 100] * 4000))
    got = {r.name: r for r in P.documents(spark, str(tmp_path)).collect()}
    assert got["a.json"].content == json.dumps({"b": [1, "甲"]}, ensure_ascii=False, indent=2) and got["b.json"].content == "{no json"
    assert len(got["c.json"].content) == 300_000 and got["c.json"].truncated and not got["a.json"].truncated


def test_texts(spark, tmp_path):
    files = {"a.py": b"x = 1\xff", "b.txt": b"ab\0c", "c.txt": b"a" * 9000 + b"\0", "d.tif": b"text", "e.log": b"x" * (2 * 1024 * 1024 + 1), "f.md": b"\x10\x01\x20" * 50, "g.txt": b"\xa0\x0b" * 30, "txt": b"no suffix", "h.LOCK": b"x", "i.tsv": b"a\tb", "j.dat": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: r for r in P.texts(spark, str(tmp_path)).collect()}
    assert {n for n, r in got.items() if r.previewable} == {"a.py", "c.txt", "f.md", "g.txt", "h.LOCK", "i.tsv"}
    assert got["a.py"].content == "x = 1\ufffd" and got["b.txt"].content is None and got["e.log"].size == 2 * 1024 * 1024 + 1


def test_name_field(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, "b", None, 2)], "geometry string, name string, area_name string, n int")
    assert rules.name_field(df, rules.ROI_FIELDS) == "name" and rules.name_field(df.drop("name"), rules.ROI_FIELDS) == "n"
    assert rules.name_field(df, (), "area_name") == "area_name" and rules.name_field(df.select("geometry"), ()) is None
    with pytest.raises(ValueError, match="no field x"):
        rules.name_field(df, (), "x")


def test_retries_that_never_end(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    got = {(r.k, r.round) for r in rules.in_rounds(items, "k", lambda left, n: left.withColumn("ok", F.col("k") == 1), 3).collect()}
    assert got == {(1, 1), (2, None)}
