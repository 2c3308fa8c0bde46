"""Spatial joins and area sums over boxes (minx, miny, maxx, maxy), as equi-joins on grid cells.

A pair of boxes that meet shares at least one cell; it is kept in one cell only (that of the larger of the
lower corners), so no pass over the pairs is needed to drop repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import geometry as G
from terrafold.functions.geometry import overlap
from terrafold.functions.names import grid_id
from terrafold.functions.numbers import MU_PER_M2

BOX = ("minx", "miny", "maxx", "maxy")
#: Pairs that a task looks at at once.
AT_ONCE = 1 << 20


def with_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a box touches: cell_x, cell_y."""
    over = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    return boxes.withColumn("cell_x", over("minx", "maxx")).withColumn("cell_y", over("miny", "maxy"))


def box_join(left: DataFrame, right: DataFrame, cell: float, keep_touching: bool = False) -> DataFrame:
    """Pairs of boxes with the area they share (``area``); columns of ``right`` that ``left`` has get an ``r_`` before them.

    Boxes that only touch are left out unless ``keep_touching``. Null bounds match nothing."""
    clash = [c for c in right.columns if c in left.columns]
    right = right.withColumnsRenamed({c: f"r_{c}" for c in clash})
    r = {c: f"r_{c}" if c in clash else c for c in BOX}
    cells = with_cells(right.withColumnsRenamed({v: k for k, v in r.items()}), cell).withColumnsRenamed(r)
    pairs = with_cells(left, cell).join(cells, ["cell_x", "cell_y"])
    corner = lambda a, b: F.floor(F.greatest(F.col(a), F.col(b)) / cell)
    pairs = pairs.where((F.col("cell_x") == corner("minx", r["minx"])) & (F.col("cell_y") == corner("miny", r["miny"])))
    meet = (F.col("minx") <= F.col(r["maxx"])) & (F.col(r["minx"]) <= F.col("maxx")) & (F.col("miny") <= F.col(r["maxy"])) & (F.col(r["miny"]) <= F.col("maxy"))
    pairs = pairs.where(meet).withColumn("area", overlap("", "r_" if clash else "")).drop("cell_x", "cell_y")
    return pairs if keep_touching else pairs.where("area > 0")


def area_by_region(parcels: DataFrame, regions: DataFrame, keys: list[str], cell: float, by: list[str] | None = None) -> DataFrame:
    """Area (m2 and mu) and number of parcels that fall in each region, by further columns of the parcels."""
    joined = box_join(parcels, regions, cell)
    sums = joined.groupBy(*(by or []), *keys).agg(F.sum("area").alias("area_m2"), F.count("*").alias("hits"))
    return sums.withColumn("area_mu", F.round(F.col("area_m2") * MU_PER_M2, 6))


def region_totals(parcels: DataFrame, regions: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Every region with its area, the number of files that contribute and of hits; regions without any have zeros."""
    per_file = area_by_region(parcels, regions, keys, cell, ["source_file"])
    sums = per_file.groupBy(*keys).agg(F.sum("area_m2").alias("area_m2"), F.count("*").alias("files"), F.sum("hits").alias("hits"))
    out = regions.select(*keys).distinct().join(sums, keys, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("area_m2", "files", "hits")))


def polygon_area_by_region(parcels: DataFrame, regions: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """As ``area_by_region`` for parcels with ``rings``: their boxes meet in cells, then the rings are cut by the region's box.

    Parcels whose box meets a region but whose rings share no area with it don't count."""
    boxed = parcels.withColumn("_b", G.bounds(F.col("rings"))).select("rings", "_b.*")
    pairs = box_join(boxed, regions, cell)
    area = G.clipped_area(F.col("rings"), *(F.col(f"r_{c}") for c in BOX))
    return pairs.withColumn("area", area).where("area > 0").groupBy(*keys).agg(F.sum("area").alias("area_m2"), F.count("*").alias("hits"))


def grid_by_boundary(cells: DataFrame, rings: Column, size: float) -> DataFrame:
    """Cells with what they share with one boundary (``rings``): area, whether it meets, holds the centre, or covers the cell."""
    x, y = F.col("xmin_m"), F.col("ymin_m")
    area = G.clipped_area(rings, x, y, x + size, y + size)
    out = cells.withColumn("clip_m2", area)
    return out.withColumn("meets", F.col("clip_m2") > 1e-6).withColumn("centre", G.covers_point(rings, x + size / 2, y + size / 2)).withColumn("within", F.col("clip_m2") >= size * size - 1e-6)


def unique_area(boxes: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """Area of the union of boxes by key: boxes are cut at tiles, and each tile is swept over its x stretches.

    Within a tile, each stretch between neighbouring x edges adds its width times the length of the union of
    the y intervals over it, which a running maximum finds."""
    cut = with_cells(boxes, tile)
    bound = lambda c, low, k: F.greatest(F.col(c), F.col(k) * tile) if low else F.least(F.col(c), (F.col(k) + 1) * tile)
    cut = cut.select(*keys, "cell_x", "cell_y", bound("minx", True, "cell_x").alias("minx"), bound("miny", True, "cell_y").alias("miny"), bound("maxx", False, "cell_x").alias("maxx"), bound("maxy", False, "cell_y").alias("maxy"))
    cut = cut.where("maxx > minx and maxy > miny").distinct()
    group = [*keys, "cell_x", "cell_y"]
    edges = cut.select(*group, F.explode(F.array("minx", "maxx")).alias("x")).distinct()
    stretch = edges.withColumn("x2", F.lead("x").over(Window.partitionBy(*group).orderBy("x"))).where("x2 is not null")
    strips = stretch.join(cut, group).where("minx <= x and maxx >= x2").select(*group, "x", "x2", "miny", "maxy")
    before = Window.partitionBy(*group, "x").orderBy("miny", "maxy").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.withColumn("top", F.max("maxy").over(before))
    fresh = F.greatest(F.col("maxy") - F.greatest(F.col("miny"), F.coalesce("top", F.col("miny"))), F.lit(0.0))
    return strips.groupBy(*keys).agg(F.sum(fresh * (F.col("x2") - F.col("x"))).alias("unique_area_m2"))


def grid(bounds: DataFrame, size: float) -> DataFrame:
    """Regular cells over bounds aligned to whole cells: grid_id, row, col, xmin_m, ymin_m, size_m, area_m2; rows count from the top."""
    lo = lambda c: F.floor(F.col(c) / size)
    hi = lambda c: F.ceil(F.col(c) / size)
    cells = bounds.withColumn("gy", F.explode(F.sequence(lo("miny"), hi("maxy") - 1))).withColumn("gx", F.explode(F.sequence(lo("minx"), hi("maxx") - 1)))
    row, col = (hi("maxy") - 1 - F.col("gy")).cast("int"), (F.col("gx") - lo("minx")).cast("int")
    return cells.select(grid_id(row, col).alias("grid_id"), row.alias("row"), col.alias("col"), (F.col("gx") * size).cast("double").alias("xmin_m"), (F.col("gy") * size).cast("double").alias("ymin_m"), F.lit(float(size)).alias("size_m"), F.lit(float(size * size)).alias("area_m2"))


def _meeting(parcels: DataFrame, key: str, cell: float, made, schema: str) -> DataFrame:
    """What ``made`` makes of the pairs of different parcels that share area, each met once.

    Parcels are dealt out to cells, and a task goes through a cell in the order of minx: it holds those that reach as far
    as the next ones begin, and no pair is shuffled. ``made`` gets the held rows (key column, minx, miny, maxx, maxy)
    and the places of some pairs in them with their area, and gives arrays of columns."""
    known = parcels.select(key, *BOX).where(" and ".join(f"`{c}` is not null" for c in (key, *BOX)))
    cells = with_cells(known, cell).repartition("cell_x", "cell_y").sortWithinPartitions("cell_x", "cell_y", "minx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            old = 0
            if held is not None:
                stay = (held["cell_x"].to_numpy() == b["cell_x"][0].as_py()) & (held["cell_y"].to_numpy() == b["cell_y"][0].as_py()) & (held["maxx"].to_numpy() > b["minx"][0].as_py())
                rows, old = pa.concat_tables([held.filter(pa.array(stay)), rows]), int(stay.sum())
            rows = rows.combine_chunks()
            x0, y0, x1, y1, cx, cy = (rows[c].to_numpy() for c in (*BOX, "cell_x", "cell_y"))
            own_x, own_y = np.floor(x0 / cell) == cx, np.floor(y0 / cell) == cy
            new = np.flatnonzero(np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])))
            first = last = np.zeros(0, np.int64)
            for a, z in zip(new.tolist(), [*new[1:].tolist(), len(cx)], strict=True):
                # the later one of a pair begins in this cell and before the other ends
                begin = a + int(np.searchsorted(own_x[a:z], True)) if own_x[a:z].any() else z
                first = np.append(first, np.maximum(np.arange(a, z) + 1, max(begin, old)))
                last = np.append(last, a + np.searchsorted(x0[a:z], x1[a:z]))
            many = np.maximum(last - first, 0)
            upto = np.append(0, np.cumsum(many))
            k = 0
            while k < len(many):
                end = max(k + 1, int(np.searchsorted(upto, upto[k] + AT_ONCE, side="right")) - 1)
                i = np.repeat(np.arange(k, end), many[k:end])
                j = np.arange(len(i)) - np.repeat(upto[k:end] - upto[k], many[k:end]) + np.repeat(first[k:end], many[k:end])
                k = end
                ok = (own_y[i] | own_y[j]) & (y0[i] < y1[j]) & (y0[j] < y1[i])
                i, j = i[ok], j[ok]
                area = (np.minimum(x1[i], x1[j]) - x0[j]) * (np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j]))
                ok = area > 0
                if ok.any():
                    yield from made(rows, i[ok], j[ok], area[ok])
            tail = (cx == cx[-1]) & (cy == cy[-1])
            held = rows.filter(pa.array(tail))

    return cells.mapInArrow(run, schema)


def _in_order(rows: pa.Table, key: str, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are of different keys, and the places of their smaller and larger key."""
    values = rows[key].to_numpy()
    rank = values if values.dtype.kind in "iuf" else np.unique(values, return_inverse=True)[1]
    apart = rank[i] != rank[j]
    i, j = i[apart], j[apart]
    less = rank[i] < rank[j]
    return apart, np.where(less, i, j), np.where(less, j, i)


def overlaps(parcels: DataFrame, key: str, cell: float, least_m2: float) -> DataFrame:
    """Pairs of different parcels that share at least ``least_m2`` and some area: a, b (a < b) and the area."""

    def made(rows: pa.Table, i: np.ndarray, j: np.ndarray, area: np.ndarray) -> Iterator[pa.RecordBatch]:
        enough = area >= least_m2
        apart, a, b = _in_order(rows, key, i[enough], j[enough])
        area, keys = area[enough][apart], rows[key].combine_chunks()
        for k in range(0, len(a), 1 << 16):
            some = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a[some])), keys.take(pa.array(b[some])), pa.array(area[some])], ["a", "b", "area"])

    kind = parcels.schema[key].dataType.simpleString()
    return _meeting(parcels, key, cell, made, f"a {kind}, b {kind}, area double")


def overlap_losses(parcels: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, lost_m2, overlaps): of overlapping parcels, the area each loses, as ``tables.kept_by_largest`` tells of pairs.

    Pairs are summed up where they meet, so what is shuffled grows with the parcels, not with the pairs."""

    def made(rows: pa.Table, i: np.ndarray, j: np.ndarray, area: np.ndarray) -> Iterator[pa.RecordBatch]:
        apart, a, b = _in_order(rows, key, i, j)
        x0, y0, x1, y1 = (rows[c].to_numpy() for c in BOX)
        size = (x1 - x0) * (y1 - y0)
        loser = np.where(size[a] >= size[b], b, a)
        n = np.bincount(loser, minlength=len(size))
        at = np.flatnonzero(n)
        lost = np.bincount(loser, area[apart], len(size))
        yield pa.RecordBatch.from_arrays([rows[key].combine_chunks().take(pa.array(at)), pa.array(lost[at]), pa.array(n[at].astype(np.int64))], [key, "lost_m2", "overlaps"])

    kind = parcels.schema[key].dataType.simpleString()
    sums = _meeting(parcels, key, cell, made, f"`{key}` {kind}, lost_m2 double, overlaps long")
    return sums.groupBy(key).agg(F.sum("lost_m2").alias("lost_m2"), F.sum("overlaps").alias("overlaps"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two periods by file: areas, counts, their differences and the percentage (NaN without a base)."""
    one = lambda df, s: df.groupBy("source_file").agg(F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias(f"area_{s}"), F.count("*").alias(f"parcels_{s}"))
    both = one(left, "before").join(one(right, "after"), "source_file", "full_outer").na.fill(0)
    d: Column = F.col("area_after") - F.col("area_before")
    return both.withColumn("difference", d).withColumn("percent", F.when(F.col("area_before") > 0, F.round(F.abs(d) / F.col("area_before") * 100, 4)).otherwise(F.lit(float("nan"))))
