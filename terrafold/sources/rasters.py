"""Raster headers (TIFF and BigTIFF) as rows, from the few byte ranges that hold them; pixels are never read.

A file is a chain of directories of tags: the first is the raster, those marked as reduced are its pyramid levels."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: tags, sizes and codes of the kinds of numbers, names of compressions and sample formats.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, SAMPLES, STRIP, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, FORMAT = 254, 256, 257, 258, 259, 270, 277, 278, 317, 322, 323, 339
SCALE, TIEPOINT, MATRIX, GEOKEYS, GEOTEXTS, METADATA, NODATA = 33550, 33922, 34264, 34735, 34737, 42112, 42113
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
COMPRESSIONS = {1: "NONE", 5: "LZW", 7: "JPEG", 8: "DEFLATE", 32773: "PACKBITS", 32946: "DEFLATE", 34887: "LERC", 50000: "ZSTD", 50001: "WEBP"}
FORMATS = {1: "uint", 2: "int", 3: "float", 5: "cint", 6: "cfloat"}
PROJECTED, GEOGRAPHIC, OWN, CITATION = 3072, 2048, 32767, 1026
#: Directories, and values of one tag, that a whole header may have; more is taken for a damaged file.
MOST_DIRECTORIES, MOST_VALUES = 64, 1 << 20


class BadRaster(ValueError):
    """The file isn't a TIFF, or its header is cut short or goes in circles."""


def directories(read: Callable[[int, int], bytes]) -> list[dict[int, tuple]]:
    """The tags of each directory, each with its values (texts as one); ``read(at, n)`` gives n bytes of the file."""

    def get(at: int, n: int) -> bytes:
        raw = read(at, n)
        if len(raw) < n:
            raise BadRaster("the header is cut short")
        return raw

    head = get(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise BadRaster("not a TIFF")
    big = version == 43
    at = struct.unpack(f"{order}Q", get(8, 8))[0] if big else struct.unpack(f"{order}I", head[4:])[0]
    count_size, entry_size, inline, offset = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    out: list[dict[int, tuple]] = []
    seen = set()
    while at:
        if at in seen or len(out) >= MOST_DIRECTORIES:
            raise BadRaster("directories go in circles")
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), get(at, count_size))[0]
        if n > 4096:
            raise BadRaster("too many tags")
        raw = get(at + count_size, n * entry_size + inline)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * entry_size)
            if kind not in KINDS or tag in (273, 279, 324, 325, 330):  # where the pixels are is of no interest
                continue
            size, code = KINDS[kind]
            if count > MOST_VALUES:
                raise BadRaster(f"tag {tag} has too many values")
            place = k * entry_size + entry_size - inline
            data = raw[place : place + size * count] if size * count <= inline else get(struct.unpack_from(order + offset, raw, place)[0], size * count)
            tags[tag] = (data,) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", data)
        out.append(tags)
        at = struct.unpack_from(order + offset, raw, n * entry_size)[0]
    if not out:
        raise BadRaster("no directory")
    return out


def _text(tags: dict[int, tuple], tag: int) -> str | None:
    return tags[tag][0].split(b"\0")[0].decode("utf-8", "replace").strip() or None if tag in tags else None


def header(read: Callable[[int, int], bytes]) -> dict:
    """What the columns of ``headers`` tell of one file."""
    levels = directories(read)
    first = levels[0]
    one = lambda tag, default=None, tags=first: tags[tag][0] if tags.get(tag) else default
    if not one(WIDTH) or not one(HEIGHT):
        raise BadRaster("no size")
    width, height = int(one(WIDTH)), int(one(HEIGHT))
    kind = f"{FORMATS.get(one(FORMAT, 1), 'unknown')}{one(BITS, 1)}"
    out = {"width": width, "height": height, "bands": int(one(SAMPLES, 1)), "dtype": kind, "compression": COMPRESSIONS.get(one(COMPRESSION, 1), str(one(COMPRESSION))), "predictor": int(one(PREDICTOR, 1))}
    tiled = TILE_WIDTH in first
    out |= {"tiled": tiled, "block_width": int(one(TILE_WIDTH, width)), "block_height": int(one(TILE_HEIGHT, min(one(STRIP, height), height)))}
    reduced = [t for t in levels[1:] if one(SUBFILE, 0, t) & 1 and not one(SUBFILE, 0, t) & 4 and one(WIDTH, 0, t)]
    out["overviews"] = [round(width / one(WIDTH, 1, t)) for t in reduced]
    out["has_mask"] = any(one(SUBFILE, 0, t) & 4 for t in levels[1:])
    nodata = _text(first, NODATA)
    try:
        out["nodata"] = float(nodata) if nodata else None
    except ValueError:
        out["nodata"] = None
    keys = first.get(GEOKEYS, ())
    found = {keys[k]: (keys[k + 1], keys[k + 2], keys[k + 3]) for k in range(4, len(keys) - 3, 4)}
    value = lambda key: found[key][2] if key in found and found[key][0] == 0 else None
    code = next((c for c in (value(PROJECTED), value(GEOGRAPHIC)) if c and c != OWN), None)
    out["crs"] = f"EPSG:{code}" if code else None
    if not code and CITATION in found and GEOTEXTS in first:
        _, n, at = found[CITATION]
        out["crs"] = first[GEOTEXTS][0][at : at + n].decode("utf-8", "replace").rstrip("|\0") or None
    scale, tie, matrix = first.get(SCALE), first.get(TIEPOINT), first.get(MATRIX)
    if scale and tie and len(tie) >= 6:
        out |= {"res_x": scale[0], "res_y": scale[1], "left": tie[3] - tie[0] * scale[0], "top": tie[4] + tie[1] * scale[1]}
    elif matrix and len(matrix) == 16:
        out |= {"res_x": matrix[0], "res_y": -matrix[5], "left": matrix[3], "top": matrix[7]}
    else:
        out |= {"res_x": None, "res_y": None, "left": None, "top": None}
    out |= {"description": _text(first, DESCRIPTION), "metadata": _text(first, METADATA)}
    return out


_TYPES = {"path": pa.string(), "length": pa.int64(), "error": pa.string(), "width": pa.int64(), "height": pa.int64(), "bands": pa.int32(), "dtype": pa.string(), "compression": pa.string(), "predictor": pa.int32(), "tiled": pa.bool_(), "block_width": pa.int64(), "block_height": pa.int64(), "overviews": pa.list_(pa.int32()), "has_mask": pa.bool_(), "nodata": pa.float64(), "crs": pa.string(), "res_x": pa.float64(), "res_y": pa.float64(), "left": pa.float64(), "top": pa.float64(), "description": pa.string(), "metadata": pa.string()}
_SCHEMA = "path string, length long, error string, width long, height long, bands int, dtype string, compression string, predictor int, tiled boolean, block_width long, block_height long, overviews array<int>, has_mask boolean, nodata double, crs string, res_x double, res_y double, left double, top double, description string, metadata string"


def _open(path: str) -> pa.NativeFile:
    at = "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
    store, place = (fs.LocalFileSystem(), at) if at.startswith("/") else fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def headers(files: DataFrame) -> DataFrame:
    """A row for each of ``files`` (path, length): its size, bands, type, blocks, pyramid, nodata, system and place.

    A file that is empty, damaged or no TIFF has the reason as ``error`` and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(_TYPES) | {"path": path, "length": length}
                try:
                    with _open(path) as f:
                        row |= header(lambda at, n, f=f: f.read_at(n, at))
                except (BadRaster, OSError, struct.error) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()})

    return files.select("path", F.col("length").cast("long").alias("length")).mapInArrow(run, _SCHEMA)


def listing(spark: SparkSession, path: str, recursive: bool = True, without: str | None = None) -> DataFrame:
    """(path, name, length) of the TIFFs at a path (a folder or one file), in order; hidden files and those below the
    folder ``without`` (an output inside of the input) are left out, as are empty ones (Spark lists none). Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[tT][iI][fF]*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), "length").where(F.lower("name").rlike(r"\.tiff?$") & ~F.col("name").startswith("."))
    if without:
        folder = F.regexp_replace(F.lit(without.rstrip("/") + "/"), r"^file:/+", "/")
        out = out.where(~F.regexp_replace("path", r"^file:/+", "/").startswith(folder))
    return out.orderBy(F.lower("path"), "path")


def bounds(h: str = "") -> Column:
    """(minx, miny, maxx, maxy) of a header's row; null without a place."""
    c = lambda n: F.col(f"{h}{n}")
    right, bottom = c("left") + c("width") * c("res_x"), c("top") - c("height") * c("res_y")
    return F.struct(F.least(c("left"), right).alias("minx"), F.least(c("top"), bottom).alias("miny"), F.greatest(c("left"), right).alias("maxx"), F.greatest(c("top"), bottom).alias("maxy"))


def usable(bands: int = 4) -> Column:
    """Whether a header's file can be worked on: it is readable, not empty, and has the bands."""
    return F.coalesce(F.col("error").isNull() & (F.col("length") > 0) & (F.col("bands") >= bands) & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))


def complete(crs: str, resolution: float, block: int, compression: str = "LZW", least: int = 256) -> Column:
    """Whether an output is finished: system, resolution (to 1e-9), compression, blocks and as many pyramid levels as
    its size asks for (powers of two for which the longer side keeps ``least`` pixels, up to 256)."""
    longer = F.greatest("width", "height")
    levels = F.size(F.filter(F.array(*(F.lit(2**k) for k in range(1, 9))), lambda f: F.floor(longer / f) >= least))
    near = lambda c: F.abs(F.abs(F.col(c)) - resolution) <= 1e-9
    rules = F.col("error").isNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("crs") == crs) & near("res_x") & near("res_y") & (F.col("compression") == compression)
    return F.coalesce(rules & F.col("tiled") & (F.col("block_width") == block) & (F.col("block_height") == block) & (F.size("overviews") == levels), F.lit(False))


def finished(outputs: DataFrame, rule: Column) -> DataFrame:
    """(path, complete): outputs (headers of .tif and .ovr files) that keep the rule and have a readable pyramid file beside them."""
    side = outputs.where(F.lower("path").endswith(".ovr") & F.col("error").isNull() & (F.col("width") > 0)).select(F.regexp_replace("path", r"(?i)\.ovr$", "").alias("path")).distinct().withColumn("beside", F.lit(True))
    own = outputs.where(~F.lower("path").endswith(".ovr")).withColumn("kept", rule)
    return own.join(side, "path", "left").select("path", (F.col("kept") & F.coalesce("beside", F.lit(False))).alias("complete"))


def scanned(found: DataFrame, pattern: str, project: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Headers with ``tile`` and ``sensing`` (the pattern's two groups, matched against the whole name), the
    ``footprint`` (bounds, by 21 points a side where they are projected) and a ``status``: 'ok', 'name' (the name doesn't
    match), 'crs' (no system or place) or 'unreadable'."""
    from terrafold.functions import geometry as G

    name = F.element_at(F.split("path", "/"), -1)
    whole = f"^(?:{pattern})$"
    b = bounds()
    foot = G.densified_bounds(b["minx"], b["miny"], b["maxx"], b["maxy"], project) if project else b
    status = F.when(~name.rlike(whole), "name").when(F.col("error").isNotNull(), "unreadable").when(F.col("crs").isNull() | F.col("left").isNull(), "crs").otherwise("ok")
    out = found.withColumn("status", status)
    part = lambda k: F.when(F.col("status") != "name", F.upper(F.regexp_extract(name, whole, k)))
    return out.withColumns({"tile": part(1), "sensing": part(2), "footprint": F.when(F.col("status") == "ok", foot)})


def unmarked(nodata: float = 0.0) -> Column:
    """Whether the header still needs the no-data value set."""
    return F.col("error").isNull() & (F.col("nodata").isNull() | (F.col("nodata") != nodata))
