"""Fewer points: convex hulls, simplified borders that neighbours share, outlines for catalogue queries, previews.

Borders are cut into arcs where three or more meet, and each arc is simplified once, so neighbours stay gapless. Arcs
that would cross others are simplified less, round by round, until none does."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from terrafold.functions import geometry as G
from terrafold.operators.ranges import written
from terrafold.operators.spatial import box_join

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
#: Rounds in which arcs that cross are simplified with half the tolerance; after these they stay as they were.
ROUNDS = 4


class Chain:
    """The convex hull of points that come in order (monotone chain): only corners so far are held."""

    def __init__(self) -> None:
        self.lower: list[tuple] = []
        self.upper: list[tuple] = []

    def add(self, p: tuple) -> None:
        for half, side in ((self.lower, 1), (self.upper, -1)):
            if half and half[-1] == p:
                return
            while len(half) > 1 and side * ((half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0])) <= 0:
                half.pop()
            half.append(p)

    def corners(self) -> list[tuple]:
        """Counter-clockwise from the leftmost; points on the hull's sides and repeats are no corners."""
        return self.lower[:-1] + self.upper[:0:-1] if len(self.lower) > 1 else self.lower


def _hulls_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, x, y, place) of the hulls of rows (name, x, y) that are sorted by all three."""
    schema = pa.schema([("name", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("place", pa.int64())])
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []
    for name, points in groupby(rows, key=lambda row: row[0]):
        hull = Chain()
        for _, x, y in points:
            hull.add((x, y))
        out += [(name, *p, k) for k, p in enumerate(hull.corners())]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, ring): the convex hull of each key's points (key, x, y), closed, counter-clockwise, from the leftmost corner.

    A key's points are dealt out in 32 parts, each has a hull of its own, and these are merged: hulls of hulls, found in
    streams of sorted points, so no task holds a key's points. Points with a null or non-finite coordinate are left out. A key whose points are in line has
    the two ends (or the one point) instead of a ring; null keys are a key."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = points.select(F.col(key).cast("string").alias("_text"), F.col(key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(ok)
    named = rows.select(F.coalesce(F.concat(F.lit("="), "_text"), F.lit("null")).alias("name"), "x", "y")

    schema = "name string, x double, y double, place long"
    dealt = named.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(32)).cast("int")).repartition("name", "part").sortWithinPartitions("name", "part", "x", "y")
    # a name's parts follow one another in a task and are told apart by the name
    some = dealt.select(F.concat_ws("|", "part", "name").alias("name"), "x", "y").mapInArrow(_hulls_of, schema)
    parts = some.select(F.regexp_replace("name", r"^\d+\|", "").alias("name"), "x", "y")
    whole = parts.repartition("name").sortWithinPartitions("name", "x", "y").mapInArrow(_hulls_of, schema)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("x", "y").alias("p")))), lambda v: v["p"])
    out = whole.groupBy("name").agg(ring.alias("ring"))
    out = out.withColumn("ring", F.when(F.size("ring") > 2, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring")))
    keys = points.select(F.col(key), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("name")).distinct()
    return out.join(keys, "name").select(key, "ring")


def kept_corners(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that a line keeps so that none it drops is further than the tolerance from it (Douglas-Peucker, with a stack).

    A closed line keeps its end and the two points that span it most, so that it stays a ring."""
    n = len(points)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    if n > 3 and (points[0] == points[-1]).all():
        far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
        off = np.abs((points[:, 0] - points[0, 0]) * (points[far, 1] - points[0, 1]) - (points[:, 1] - points[0, 1]) * (points[far, 0] - points[0, 0]))
        side = int(np.argmax(off))
        ends = sorted({0, far, side, n - 1})
        keep[ends] = True
        todo = list(zip(ends, ends[1:], strict=False))
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b, mid = points[i], points[j], points[i + 1 : j]
        d = b - a
        size = float(d @ d)
        t = np.clip((mid - a) @ d / size, 0, 1) if size else np.zeros(len(mid))
        gap = ((mid - a - t[:, None] * d) ** 2).sum(axis=1)
        k = int(np.argmax(gap))
        if gap[k] > tolerance * tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


@F.pandas_udf(RING)
def _simpler(lines, tolerances):
    """Each line by its own tolerance; as it is if that is null."""
    import pandas as pd

    out = []
    for line, t in zip(lines, tolerances, strict=True):
        points = [(p["x"], p["y"]) for p in line]
        kept = range(len(points)) if pd.isna(t) else kept_corners(np.array(points, float), t)
        out.append([{"x": points[k][0], "y": points[k][1]} for k in kept])
    return pd.Series(out)


def arcs(shapes: DataFrame, key: str) -> DataFrame:
    """(key, ring, arc, flipped, line): the borders of shapes (key, rings), cut where borders part.

    A point where all borders have the same two neighbours lies within an arc. An arc that two shapes share is the same
    line in both, from its lesser end; ``flipped`` tells which ring runs the other way. Rings lose repeated points."""
    opened = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, F.greatest(i - 1, F.lit(0)))))
    ring = F.explode(F.transform("rings", lambda r, i: F.struct(i.alias("ring"), opened(r).alias("points"))))
    rings = shapes.select(F.col(key).alias("_key"), ring.alias("r")).select("_key", "r.*")
    rings = rings.withColumn("points", F.when(F.get("points", F.lit(0)) == F.element_at("points", -1), F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points"))).where(F.size("points") > 2)
    n = F.size("points")
    each = rings.select("_key", "ring", n.alias("n"), F.posexplode(F.transform("points", lambda p, i: F.struct(p.alias("p"), F.get("points", F.pmod(i - 1, n)).alias("before"), F.get("points", F.pmod(i + 1, n)).alias("after")))).alias("pos", "v")).select("_key", "ring", "n", "pos", "v.*")
    low, high = F.least("before", "after"), F.greatest("before", "after")
    meet = each.groupBy("p").agg((F.min(low) != F.max(low)).alias("a"), (F.min(high) != F.max(high)).alias("b")).select("p", (F.col("a") | F.col("b")).alias("node"))
    each = each.join(meet, "p")
    own = Window.partitionBy("_key", "ring")
    first = F.min(F.when(F.col("node"), F.col("pos"))).over(own)
    least = F.min_by("pos", "p").over(own)  # a ring without nodes begins at its least point
    start = F.coalesce(first, least)
    each = each.withColumns({"start": start, "node": F.coalesce(F.col("node") & first.isNotNull(), F.lit(False))}).withColumn("pos", F.pmod(F.col("pos") - F.col("start"), F.col("n"))).withColumn("node", F.col("node") | (F.col("pos") == 0))
    each = each.withColumn("arc", F.sum(F.col("node").cast("int")).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grouped = each.groupBy("_key", "ring", "arc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda v: v["p"]).alias("line"), F.max_by("after", "pos").alias("end"))
    line = F.concat("line", F.array("end"))
    back = F.reverse(line)
    return grouped.select(F.col("_key").alias(key), "ring", "arc", (back < line).alias("flipped"), F.least(line, back).alias("line"))


def _crossed(lines: DataFrame, cell: float) -> DataFrame:
    """The ids of lines (id, line) with a segment that meets another one other than in a common end."""
    seg = lines.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.struct(F.get("line", i).alias("a"), F.get("line", i + 1).alias("b")))).alias("no", "s")).select("id", "no", "s.*")
    seg = seg.withColumns({"minx": F.least("a.x", "b.x"), "miny": F.least("a.y", "b.y"), "maxx": F.greatest("a.x", "b.x"), "maxy": F.greatest("a.y", "b.y")})
    pairs = box_join(seg, seg, cell, keep_touching=True).where(F.struct("id", "no") < F.struct("r_id", "r_no"))

    def turn(p: str, q: str, r: str) -> Column:
        return F.signum((F.col(f"{q}.x") - F.col(f"{p}.x")) * (F.col(f"{r}.y") - F.col(f"{p}.y")) - (F.col(f"{q}.y") - F.col(f"{p}.y")) * (F.col(f"{r}.x") - F.col(f"{p}.x")))

    one, two = turn("a", "b", "r_a") * turn("a", "b", "r_b"), turn("r_a", "r_b", "a") * turn("r_a", "r_b", "b")
    joined = (F.col("a") == F.col("r_a")) | (F.col("a") == F.col("r_b")) | (F.col("b") == F.col("r_a")) | (F.col("b") == F.col("r_b"))
    same = ((F.col("a") == F.col("r_a")) & (F.col("b") == F.col("r_b"))) | ((F.col("a") == F.col("r_b")) & (F.col("b") == F.col("r_a")))
    return pairs.where(((one <= 0) & (two <= 0) & ~joined) | same).select(F.explode(F.array("id", "r_id")).alias("id")).distinct()


def simplified(shapes: DataFrame, key: str, tolerance: float, cell: float) -> DataFrame:
    """(key, rings): shapes with fewer points, none of which was further than the tolerance from the new border.

    Borders that shapes share stay shared. No two borders meet that did not before: arcs that would are simplified
    with half the tolerance, and in the end not at all, as are the arcs these then meet. Rings come back closed, those
    of less than 3 points not at all. Shapes without rings have no row."""
    pieces = written(arcs(shapes, key).withColumnRenamed(key, "_key"), "arcs")
    lines = written(pieces.select("line").distinct().withColumn("id", F.monotonically_increasing_id()), "lines")
    now = written(lines.select("id", F.col("line").alias("whole"), F.lit(float(tolerance)).alias("tolerance")).withColumn("line", _simpler("whole", "tolerance")), "simpler")
    least = tolerance / 2**ROUNDS
    while True:
        crossed = written(_crossed(now, cell).join(now.where("tolerance is not null").select("id"), "id"), "crossed")
        if not crossed.limit(1).count():
            break
        less = F.when(F.col("crossed"), F.when(F.col("tolerance") > least, F.col("tolerance") / 2)).otherwise(F.col("tolerance"))
        marked = now.join(crossed.withColumn("crossed", F.lit(True)), "id", "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))
        marked = marked.withColumn("tolerance", less)
        now = written(marked.select("id", "whole", "tolerance", F.when(F.col("crossed"), _simpler("whole", "tolerance")).otherwise(F.col("line")).alias("line")), "simpler")
    found = lines.join(now.select("id", F.col("line").alias("simple")), "id").select("line", "simple")
    placed = pieces.join(found, "line").withColumn("simple", F.when(F.col("flipped"), F.reverse("simple")).otherwise(F.col("simple")))
    part = F.struct("arc", F.slice("simple", 1, F.size("simple") - 1).alias("points"))
    rings = placed.groupBy("_key", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda a: a["points"])).alias("points")).where(F.size("points") > 2)
    rings = rings.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    out = rings.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return out.withColumnRenamed("_key", key)


@F.pandas_udf(RING)
def _outline(rings, most):
    """The ring for a catalogue query: at most ``most`` points, by tolerances that double from 0.001 to 1, else the box."""
    import pandas as pd

    out = []
    for line, n in zip(rings, most, strict=True):
        points = np.array([(p["x"], p["y"]) for p in line], float)
        tolerance, short = 0.001, points  # fixed values: the first tolerance, and the last below 1
        while len(short) > n and tolerance <= 1:
            short = points[kept_corners(points, tolerance)]
            tolerance *= 2
        if len(short) > n or len(short) < 4:
            (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
            short = np.array([(x1, y0), (x1, y1), (x0, y1), (x0, y0), (x1, y0)])
        out.append([{"x": x, "y": y} for x, y in short.tolist()])
    return pd.Series(out)


def query_outlines(shapes: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(key, ring) for catalogue queries: one closed ring of at most ``most`` points for each shape (key, rings).

    A shape of one ring keeps its form; one of several rings is replaced by its convex hull (a hole is filled: pass
    the outer ring alone to keep the form). What has too many points at every tolerance, or is no area, is its box."""
    one = shapes.where(F.size("rings") > 0).select(F.col(key).alias("_key"), "rings")
    closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    single = one.where(F.size("rings") == 1).select("_key", F.get("rings", F.lit(0)).alias("ring")).where(F.size("ring") > 0).withColumn("ring", closed(F.col("ring")))
    points = one.where(F.size("rings") > 1).select("_key", F.explode(F.flatten("rings")).alias("p")).select("_key", "p.*")
    out = single.unionByName(hulls(points, "_key")).withColumn("ring", _outline("ring", F.lit(most)))
    return out.withColumnRenamed("_key", key)


def preview(features: DataFrame, most: int = 800, columns: int = 12, width: int = 180) -> DataFrame:
    """(source_file, feature_no, rings, properties): what a preview of each layer shows.

    ``features`` (source_file, feature_no, rings, attributes): the first ``most`` in order, up to the first without a
    geometry; rings simplified to 1 / 1800 of the layer's longer side (each by itself); of the attributes the first
    ``columns``, each cut at ``width`` characters."""
    by = Window.partitionBy("source_file")
    first_null = F.min(F.when(F.col("rings").isNull() | (F.size("rings") == 0), F.col("feature_no"))).over(by)
    box = features.where(F.size("rings") > 0).withColumn("b", G.bounds(F.col("rings"))).groupBy("source_file").agg(F.greatest(F.max("b.maxx") - F.min("b.minx"), F.max("b.maxy") - F.min("b.miny")).alias("span"))
    shown = features.withColumn("stop", first_null).where((F.col("feature_no") < most) & (F.col("feature_no") < F.coalesce("stop", F.lit(1 << 40))))
    each = shown.join(box, "source_file").select("source_file", "feature_no", "attributes", "span", F.posexplode("rings").alias("ring", "line"))
    each = each.withColumn("line", _simpler("line", F.col("span") / 1800))
    rings = each.groupBy("source_file", "feature_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "line"))), lambda r: r["line"]).alias("rings"))
    cut = F.transform(F.slice(F.map_entries("attributes"), 1, columns), lambda e: F.struct(e["key"].alias("key"), F.substring(e["value"], 1, width).alias("value")))
    props = shown.select("source_file", "feature_no", F.map_from_entries(F.coalesce(cut, F.array().cast("array<struct<key:string,value:string>>"))).alias("properties"))
    return rings.join(props, ["source_file", "feature_no"])
