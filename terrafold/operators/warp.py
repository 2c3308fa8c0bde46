"""Rasters in another projection: each target pixel looks up where its centre lies in the source.

Source pixels are dealt out by tiles; those near a tile's border go to the tiles beside it too (the halo), so that a
tile holds all that its target pixels interpolate from. A task sees one tile and the target pixels that fall in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import raster
from terrafold.operators.rasterize import Grid

Project = Callable[[Column, Column], tuple[Column, Column]]
#: How far around a point each method looks, in pixels.
REACH = {"nearest": 0, "bilinear": 1, "cubic": 2}


@dataclass(frozen=True)
class Frame:
    """Where a source raster's pixels are (``grid`` with width and height), and how its coordinates go to the target's and back."""

    grid: Grid
    forward: Project
    inverse: Project


def target_points(tiles: DataFrame, frame: Frame, target: Grid, tile: int) -> DataFrame:
    """(raster_id, ty, tx, row, col, u, v): target pixels by the source tile (ty, tx) that holds their centre, at column u and row v there.

    Only the given tiles (raster_id, ty, tx) are looked at. The outline of a tile, with 21 points a side, bounds its target
    pixels; where that lies beside the target there are none. They are worked out once for all rasters."""
    g = frame.grid
    x0, y1 = g.left + F.col("tx") * tile * g.size, g.top - F.col("ty") * tile * g.size
    places = tiles.select("ty", "tx").distinct().toDF("ty", "tx").where(_meets(g, tile))
    box = places.withColumn("b", G.densified_bounds(x0, y1 - tile * g.size, x0 + tile * g.size, y1, frame.forward))

    def span(low: Column, high: Column, most: int | None) -> Column:
        a, b = F.greatest(F.lit(0), F.floor(low) - 1).cast("int"), F.least(F.lit((most or 1 << 30) - 1), F.floor(high) + 1).cast("int")
        return F.when(a <= b, F.sequence(a, b))

    rows = box.withColumn("row", F.explode(span((target.top - F.col("b.maxy")) / target.size, (target.top - F.col("b.miny")) / target.size, target.height)))
    each = rows.withColumn("col", F.explode(span((F.col("b.minx") - target.left) / target.size, (F.col("b.maxx") - target.left) / target.size, target.width)))
    x, y = frame.inverse(target.left + (F.col("col") + 0.5) * target.size, target.top - (F.col("row") + 0.5) * target.size)
    at = each.select("ty", "tx", "row", "col", ((x - g.left) / g.size).alias("u"), ((g.top - y) / g.size).alias("v"))
    within = (F.floor(F.col("v") / tile) == F.col("ty")) & (F.floor(F.col("u") / tile) == F.col("tx"))
    at = at.where(within & (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < g.width) & (F.col("v") < g.height))
    return at.join(tiles.select("raster_id", "ty", "tx").toDF("raster_id", "ty", "tx"), ["ty", "tx"]).select("raster_id", "ty", "tx", "row", "col", "u", "v")


def _meets(grid: Grid, tile: int) -> Column:
    """Whether a tile (ty, tx) holds a part of the grid."""
    return (F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile < grid.height) & (F.col("tx") * tile < grid.width)


def with_halo(pixels: DataFrame, tile: int, reach: int) -> DataFrame:
    """Pixels with the tiles (ty, tx) that need them: their own, and those whose border is within ``reach``."""
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    return pixels.withColumn("ty", F.explode(near("row"))).withColumn("tx", F.explode(near("col")))


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at -1, 0, 1 and 2 for the fraction t (Catmull-Rom)."""
    return np.stack([-t / 2 + t**2 - t**3 / 2, 1 - 2.5 * t**2 + 1.5 * t**3, t / 2 + 2 * t**2 - 1.5 * t**3, -(t**2) / 2 + t**3 / 2])


def interpolated(block: np.ndarray, v: np.ndarray, u: np.ndarray, how: str) -> np.ndarray:
    """Values at rows v and columns u of a block whose missing pixels are NaN; NaN where nothing is near.

    bilinear: missing neighbours are left out and the others weigh more. cubic: where one of the 16 neighbours is
    missing, the value is the bilinear one."""
    if how == "nearest":
        return block[np.floor(v).astype(int), np.floor(u).astype(int)]
    r, c = np.floor(v - 0.5).astype(int), np.floor(u - 0.5).astype(int)
    fr, fc = v - 0.5 - r, u - 0.5 - c
    total, weight = np.zeros(len(v)), np.zeros(len(v))
    for i, wr in ((0, 1 - fr), (1, fr)):
        for j, wc in ((0, 1 - fc), (1, fc)):
            value, w = block[r + i, c + j], wr * wc
            ok = ~np.isnan(value)
            total[ok] += (w * value)[ok]
            weight[ok] += w[ok]
    out = np.divide(total, weight, out=np.full(len(v), np.nan), where=weight > 0)
    if how == "cubic":
        wr, wc = _cubic(fr), _cubic(fc)
        full = sum(wr[i] * wc[j] * block[r + i - 1, c + j - 1] for i in range(4) for j in range(4))
        out = np.where(np.isnan(full), out, full)
    return out


def warped(pixels: DataFrame, frame: Frame, target: Grid, how: str = "nearest", tile: int = 256) -> DataFrame:
    """(raster_id, row, col, band, value: double) on the target grid; places without a value have no row.

    ``pixels``: (raster_id, row, col, band, value), each place once a band; 0 and null are no data. Methods: nearest,
    bilinear, cubic. Where the two projections and grids are one, use the pixels as they are."""
    reach = REACH[how]
    valid = pixels.where("value != 0").select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("band").cast("int").alias("band"), F.col("value").cast("double").alias("value"))
    group = ["raster_id", "ty", "tx"]
    sources = with_halo(valid.withColumn("raster_id", F.col("raster_id").cast("long")), tile, reach).where(_meets(frame.grid, tile))
    points = target_points(sources.select(*group).distinct(), frame, target, tile)
    wide = tile + 2 * reach + 2

    def run(key: tuple, source: pa.Table, wanted: pa.Table) -> pa.Table:
        _, ty, tx = (k.as_py() for k in key)
        out: dict[str, list] = {"raster_id": [], "row": [], "col": [], "band": [], "value": []}
        if source.num_rows and wanted.num_rows:
            row, col, band, value = (source[c].to_numpy() for c in ("row", "col", "band", "value"))
            top, left = ty * tile - reach - 1, tx * tile - reach - 1
            v, u = wanted["v"].to_numpy() - top, wanted["u"].to_numpy() - left
            for b in np.unique(band):
                mine = band == b
                block = np.full((wide, wide), np.nan)
                block[row[mine] - top, col[mine] - left] = value[mine]
                found = interpolated(block, v, u, how)
                ok = ~np.isnan(found)
                for name, values in (("row", wanted["row"].to_numpy()[ok]), ("col", wanted["col"].to_numpy()[ok]), ("value", found[ok])):
                    out[name].append(values)
                out["band"].append(np.full(ok.sum(), b, np.int32))
                out["raster_id"].append(np.full(ok.sum(), key[0].as_py(), np.int64))
        types = {"raster_id": pa.int64(), "row": pa.int32(), "col": pa.int32(), "band": pa.int32(), "value": pa.float64()}
        return pa.table({k: pa.array(np.concatenate(x) if x else [], types[k]) for k, x in out.items()})

    return sources.groupBy(*group).cogroup(points.groupBy(*group)).applyInArrow(run, "raster_id long, row int, col int, band int, value double")


def reprojected_mosaic(pixels: DataFrame, frame: Frame, target: Grid, tile: int = 256) -> DataFrame:
    """(row, col, band, value, source): rasters warped by nearest pixel; the first valid one wins, in order of raster_id."""
    return raster.mosaic(warped(pixels, frame, target, "nearest", tile))


def kinds_differ(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rasters (bands, dtype) that cannot be merged, with what differs."""
    out = rasters.groupBy(*keys).agg(F.min("bands").alias("fewest"), F.max("bands").alias("most"), F.min("dtype").alias("one"), F.max("dtype").alias("other"))
    reason = F.when(F.col("fewest") != F.col("most"), F.format_string("bands: %d and %d", "fewest", "most")).when(F.col("one") != F.col("other"), F.concat_ws(" and ", "one", "other"))
    return out.select(*keys, reason.alias("reason")).where("reason is not null")
