"""Grid and raster arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MU_PER_M2 = 0.0015  # fixed value: area reports
M2_PER_MU = 2000 / 3  # fixed value: area-constrained rasters


def aligned(low: Column, high: Column, step: float) -> tuple[Column, Column]:
    """Bounds widened to whole steps."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def expanded(low: Column, high: Column, ratio: float) -> tuple[Column, Column]:
    size = F.when(high > low, high - low).otherwise(0.01)
    return low - size * ratio, high + size * ratio


def nice_step(size: Column, parts: int = 5) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that is at least size / parts."""
    raw = size / parts
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    n = raw / power
    return F.when(n <= 1, 1).when(n <= 2, 2).when(n <= 5, 5).otherwise(10) * power


def power_of_two(c: Column, most: int = 256) -> Column:
    return (c >= 2) & (c <= most) & (c.bitwiseAND(c - 1) == 0)


def overview_factors(width: Column, height: Column, least: int = 256, most: int = 256) -> Column:
    """Powers of two for which the longer side keeps at least ``least`` pixels."""
    powers = [2**k for k in range(1, int(math.log2(most)) + 1)]
    return F.filter(F.array(*map(F.lit, powers)), lambda f: F.floor(F.greatest(width, height) / f) >= least)


def predictor(dtype: Column) -> Column:
    return F.when(dtype.startswith("float") | dtype.startswith("complex"), 3).otherwise(2)


def difference(base: Column, other: Column) -> tuple[Column, Column]:
    """Difference and its percentage of the base; NaN without a base."""
    d = other - base
    return d, F.when(base > 0, F.abs(d) / base * 100).otherwise(F.lit(float("nan")))


def overview_levels(width: Column, height: Column, rule: str, least: int = 128, most: int = 256) -> Column:
    """Levels by the other rules: 'longest' (the longer side keeps a pixel), 'shorter' (the shorter one keeps ``least``), 'both' (each side keeps a pixel)."""
    powers = F.array(*(F.lit(2**k) for k in range(1, int(math.log2(most)) + 1)))
    side, kept = {"longest": (F.greatest(width, height), 1), "shorter": (F.least(width, height), least), "both": (F.least(width, height), 1)}[rule]
    return F.filter(powers, lambda f: F.floor(side / f) >= kept)


def fitted(minx: Column, miny: Column, maxx: Column, maxy: Column, aspect: float) -> Column:
    """Bounds widened around their middle, on one axis, to width / height = aspect."""
    w, h = maxx - minx, maxy - miny
    dx, dy = F.greatest(h * aspect - w, F.lit(0.0)) / 2, F.greatest(w / aspect - h, F.lit(0.0)) / 2
    return F.struct((minx - dx).alias("minx"), (miny - dy).alias("miny"), (maxx + dx).alias("maxx"), (maxy + dy).alias("maxy"))


def to_pixel(x: Column, y: Column, minx: Column, maxy: Column, scale: Column) -> tuple[Column, Column]:
    """Pixel of a place: columns from the left, rows from the top."""
    return (x - minx) * scale, (maxy - y) * scale


def unit_factor(x: Column, y: Column) -> Column:
    """The factor to metres if both axes agree, else null."""
    return F.when(F.abs(x - y) <= 1e-12, x)


def rate(done: Column, elapsed: Column) -> Column:
    return done / F.nullif(elapsed, F.lit(0))


def remaining(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds to go at the rate so far; null before anything is done."""
    return (total - done) / F.nullif(rate(done, elapsed), F.lit(0))


def preview_scale(width: Column, height: Column, most: int = 1200) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
