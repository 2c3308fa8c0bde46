"""Headers of TIFF files written here: both byte orders, both sizes of offsets, tiles, pyramids, damaged files."""

import struct

import pytest
from pyspark.sql import functions as F

from terrafold.sources import rasters as R

CODES = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}


def tiff(directories, order="<", big=False):
    """A file of these directories: [(tag, code, values)]; no pixels."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 16) if big else struct.pack(order + "I", 8))
    out = bytearray(head)
    for k, tags in enumerate(directories):
        n, entry, inline, o = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
        size = n + entry * len(tags) + inline
        after, body, extra = len(out) + size, bytearray(), bytearray()
        for tag, code, values in sorted(tags):
            data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
            count = len(data) if code == "s" else len(values)
            body += struct.pack(order + ("HHQ" if big else "HHI"), tag, CODES[code], count)
            if len(data) <= inline:
                body += data.ljust(inline, b"\0")
            else:
                body += struct.pack(order + o, after + len(extra))
                extra += data
        last = k == len(directories) - 1
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + body + struct.pack(order + o, 0 if last else after + len(extra)) + extra
    return bytes(out)


def main(width=1000, height=600, bands=4, crs=32649, **more):
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [16] * bands), 259: ("H", [5]), 277: ("H", [bands]), 317: ("H", [2]), 322: ("H", [256]), 323: ("H", [256]), 339: ("H", [1] * bands), 33550: ("d", [0.5, 0.5, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 400000.0, 4300000.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, crs]), 42113: ("s", b"0\0"), 324: ("I", [8] * 12)}
    tags |= {int(k[1:]): v for k, v in more.items()}
    return [(t, *v) for t, v in tags.items() if v]


def level(width, height, kind=1):
    return [(254, "I", [kind]), (256, "I", [width]), (257, "I", [height])]


@pytest.fixture()
def folder(tmp_path):
    files = {
        "T49SCD_20260621T032509.tif": tiff([main(), level(500, 300), level(1000, 600, 4)]),
        "sub/T49SCE_20260622T032509.TIF": tiff([main(), level(500, 300), level(250, 150)], ">", True),
        "sub/big.tif": tiff([main(3000, 2000, 3)], "<", True),
        "sub/plain.tiff": tiff([[(256, "H", [10]), (257, "H", [7]), (278, "H", [3])]], ">"),
        "sub/own.tif": tiff([main(t34735=("H", [1, 1, 0, 2, 3072, 0, 1, 32767, 1026, 34737, 7, 0]), t34737=("s", b"Albers|\0"), t42113=("s", b"nan\0"))]),
        "out/x.tif": tiff([main(t33550=None, t33922=None, t34264=("d", [2.0, 0, 0, 10.0, 0, -2.0, 0, 90.0, 0, 0, 0, 0, 0, 0, 0, 1.0]), t42113=None)]),
        ".hidden.tif": tiff([main()]),
        "empty.tif": b"",
        "text.tif": b"this is no raster at all",
        "cut.tif": tiff([main()])[:60],
        "T49SCD_20260621T032509.tif.ovr": tiff([main()]),
    }
    loop = bytearray(tiff([[(256, "H", [1]), (257, "H", [1])]]))
    loop[8 + 2 + 24 : 8 + 2 + 28] = struct.pack("<I", 8)
    files["circle.tif"] = bytes(loop)
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_headers(spark, folder):
    found = R.headers(R.listing(spark, folder))
    h = {r.path.split(folder + "/")[1]: r for r in found.withColumn("b", R.bounds()).withColumn("usable", R.usable()).withColumn("unmarked", R.unmarked()).collect()}
    assert len(h) == 9 and ".hidden.tif" not in h
    a, b = h["T49SCD_20260621T032509.tif"], h["sub/T49SCE_20260622T032509.TIF"]
    for r in (a, b):
        assert (r.width, r.height, r.bands, r.dtype, r.compression, r.predictor, r.tiled, r.block_width, r.nodata, r.crs) == (1000, 600, 4, "uint16", "LZW", 2, True, 256, 0.0, "EPSG:32649")
        assert tuple(r.b) == (400000.0, 4299700.0, 400500.0, 4300000.0) and r.usable and not r.unmarked and r.error is None
    assert (a.overviews, a.has_mask, b.overviews, b.has_mask) == ([2], True, [2, 4], False)
    p = h["sub/plain.tiff"]
    assert (p.bands, p.dtype, p.compression, p.tiled, p.block_width, p.block_height, p.crs, p.b.minx, p.usable) == (1, "uint1", "NONE", False, 10, 3, None, None, False)
    assert h["sub/own.tif"].crs == "Albers" and h["sub/own.tif"].unmarked and not h["sub/big.tif"].usable
    assert tuple(h["out/x.tif"].b) == (10.0, -1110.0, 2010.0, 90.0) and h["out/x.tif"].nodata is None
    assert {k: r.error for k, r in h.items() if r.error} == {"text.tif": "not a TIFF", "cut.tif": "the header is cut short", "circle.tif": "directories go in circles"}
    assert not any(r.usable or r.unmarked for r in h.values() if r.error)


def test_listing(spark, folder):
    names = [r.name for r in R.listing(spark, folder, without=folder + "/out").collect()]
    assert len(names) == 8 and "x.tif" not in names
    assert {r.name for r in R.listing(spark, folder, recursive=False).collect()} == {"T49SCD_20260621T032509.tif", "text.tif", "cut.tif", "circle.tif"}
    assert [r.name for r in R.listing(spark, folder + "/sub/big.tif").collect()] == ["big.tif"]


def test_scanned(spark, folder):
    rows = R.scanned(R.headers(R.listing(spark, folder)), r"(T\d{2}[A-Z]{3})_(\d{8}T\d{6})\.(?i:tif)", lambda x, y: (x / 2, y + 1)).collect()
    ok = {r.tile: (r.sensing, tuple(r.footprint)) for r in rows if r.status == "ok"}
    assert ok == {"T49SCD": ("20260621T032509", (200000.0, 4299701.0, 200250.0, 4300001.0)), "T49SCE": ("20260622T032509", (200000.0, 4299701.0, 200250.0, 4300001.0))}
    every = {r.path.rsplit("/", 1)[1]: r.status for r in R.scanned(R.headers(R.listing(spark, folder)), r"()().*").collect()}
    assert every["plain.tiff"] == "crs" and every["cut.tif"] == "unreadable" and every["big.tif"] == "ok"


def test_empty_file(spark, folder):
    rows = R.headers(spark.createDataFrame([(folder + "/empty.tif", 0), (folder + "/none.tif", None)], "path string, length long")).withColumn("usable", R.usable()).collect()
    assert rows[0].error == "the header is cut short" and "none.tif" in rows[1].error and not any(r.usable for r in rows)


def test_finished(spark, folder):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    found = R.headers(listed.where(F.col("path").rlike("T49|big|text")))
    got = {r.path.rsplit("/", 1)[1]: r.complete for r in R.finished(found, R.complete("EPSG:32649", 0.5, 256)).collect()}
    # 1000 pixels ask for one level of at least 256; the second file has two, the third none, and only the first has its pyramid beside it
    assert got == {"T49SCD_20260621T032509.tif": True, "T49SCE_20260622T032509.TIF": False, "big.tif": False, "text.tif": False}
    assert not any(r.complete for r in R.finished(found, R.complete("EPSG:4326", 0.5, 256)).collect())
