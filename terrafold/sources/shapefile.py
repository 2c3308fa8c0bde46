"""Shapefile layers as DataFrames: files are read by Spark (any store it can read) and parsed one in a row.

Layout of the format: a 100-byte header (code 9994 big-endian, shape type and box little-endian), then
records with a big-endian head (number, length in 16-bit words) and a little-endian body."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape types of the format.
NULL, POLYLINE, POLYGON = 0, (3, 13, 23), (5, 15, 25)
POINT, MULTIPOINT = (1, 11, 21), (8, 18, 28)
RINGS = "array<array<struct<x:double,y:double>>>"


class BadLayer(ValueError):
    """The file isn't a layer, or is cut short."""


def records(content: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(number, type, begin, end) of each record's body."""
    if len(content) < 100 or struct.unpack_from(">i", content)[0] != 9994:
        raise BadLayer("not a shapefile")
    at = 100
    while at < len(content):
        if at + 12 > len(content):
            raise BadLayer("a record head is cut short")
        number, words = struct.unpack_from(">ii", content, at)
        end = at + 8 + 2 * words
        if words < 2 or end > len(content):
            raise BadLayer("a record is cut short")
        yield number, struct.unpack_from("<i", content, at + 8)[0], at + 8, end
        at = end


def rings(content: bytes, begin: int) -> list[np.ndarray]:
    """Parts of a polygon or line record as arrays of x and y."""
    parts, points = struct.unpack_from("<ii", content, begin + 36)
    starts = np.frombuffer(content, "<i4", parts, begin + 44).tolist() + [points]
    xy = np.frombuffer(content, "<f8", 2 * points, begin + 44 + 4 * parts).reshape(-1, 2)
    return [xy[a:e] for a, e in zip(starts, starts[1:], strict=False)]


def shifted(content: bytes, dx: float, dy: float) -> bytes:
    """The layer moved by (dx, dy): points, record boxes and the file's box; null shapes, Z and M stay."""
    out = bytearray(content)

    def move(at: int, n: int) -> None:
        xy = np.frombuffer(out, "<f8", 2 * n, at).reshape(-1, 2) + (dx, dy)
        out[at : at + 16 * n] = xy.astype("<f8").tobytes()

    found = False
    for _, kind, begin, _ in records(content):
        if kind in POINT:
            move(begin + 4, 1)
        elif kind in MULTIPOINT:
            move(begin + 4, 2)
            move(begin + 40, struct.unpack_from("<i", content, begin + 36)[0])
        elif kind in POLYLINE + POLYGON:
            parts, points = struct.unpack_from("<ii", content, begin + 36)
            move(begin + 4, 2)
            move(begin + 44 + 4 * parts, points)
        elif kind != NULL:
            raise BadLayer(f"shape type {kind} can't be moved")
        found |= kind != NULL
    if found:
        move(36, 2)
    return bytes(out)


def layer(shapes: list[list[np.ndarray] | None]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of polygons, each a list of rings, or None for a null shape."""
    body, index, at, box = [], [], 50, [np.inf, np.inf, -np.inf, -np.inf]
    for k, parts in enumerate(shapes, 1):
        if parts:
            xy = np.concatenate(parts)
            low, high = xy.min(axis=0), xy.max(axis=0)
            box = [*np.minimum(box[:2], low), *np.maximum(box[2:], high)]
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype("<i4")
            record = struct.pack("<i4dii", 5, *low, *high, len(parts), len(xy)) + starts.tobytes() + xy.astype("<f8").tobytes()
        else:
            record = struct.pack("<i", NULL)
        body.append(struct.pack(">ii", k, len(record) // 2) + record)
        index.append(struct.pack(">ii", at, len(record) // 2))
        at += len(body[-1]) // 2
    if box[0] > box[2]:
        box = [0.0] * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i4d", 1000, 5, *box) + bytes(32)
    return head(at) + b"".join(body), head(50 + 4 * len(index)) + b"".join(index)


def attributes(content: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """Rows of a .dbf as texts; blank values are null, deleted rows stay (they keep their shape's number)."""
    count, head, width = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), content[at + 16]))
        at += 32
    out = []
    for k in range(count):
        place, row = head + k * width + 1, {}
        for name, size in fields:
            row[name] = content[place : place + size].decode(encoding, "replace").strip() or None
            place += size
        out.append(row)
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def listing(spark: SparkSession, path: str, glob: str = "*.[sS][hH][pP]") -> DataFrame:
    """(path, length, modificationTime) of layers below a folder, by path without regard to case; contents aren't read."""
    return _files(spark, path, glob).select("path", "length", "modificationTime").orderBy(F.lower("path"), "path")


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, features) from the sizes of the index files alone."""
    return _files(spark, path, "*.[sS][hH][xX]").select("path", F.expr("(length - 100) div 8").alias("features"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, feature_no, kind, rings, attributes) of every feature; null and non-area shapes have null rings.

    A layer that can't be read is one row with kind -1 and the reason as its attribute ``error``, so that a bad
    file neither stops the others nor goes unseen. Attributes join by folder, stem and number."""

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.list_(point)), pa.string())

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for k, (_, kind, begin, _) in enumerate(records(content)):
                        area = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings(content, begin)] if kind in POLYGON else None
                        rows.append((name, k, kind, area, None))
                except BadLayer as e:
                    rows = [(name, 0, -1, None, str(e))]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["source_file", "feature_no", "kind", "rings", "error"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = attributes(content)
                maps = pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), maps], ["key", "feature_no", "attributes"])

    key = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]+$", ""))
    left = _files(spark, path, "*.[sS][hH][pP]").select("path", "content").mapInArrow(shapes, f"source_file string, feature_no long, kind int, rings {RINGS}, error string")
    right = _files(spark, path, "*.[dD][bB][fF]").select("path", "content").mapInArrow(values, "key string, feature_no long, attributes map<string,string>")
    out = left.withColumn("key", key(F.col("source_file"))).join(right.withColumn("key", key(F.col("key"))), ["key", "feature_no"], "left")
    told = F.when(F.col("error").isNotNull(), F.create_map(F.lit("error"), "error")).otherwise(F.col("attributes"))
    return out.select("source_file", "feature_no", "kind", "rings", told.alias("attributes"))


def moved_layers(spark: SparkSession, path: str, dx: float, dy: float) -> DataFrame:
    """(path, content) of each layer moved by (dx, dy)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [shifted(c, dx, dy) for c in b["content"]]})

    return _files(spark, path, "*.[sS][hH][pP]").select("path", "content").mapInPandas(run, "path string, content binary")
