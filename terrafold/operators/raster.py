"""Raster work on pixel rows (raster_id, row, col, band, value; 0 is no data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_pixels(pixels: DataFrame) -> DataFrame:
    """Places with a value in any band."""
    return pixels.groupBy("raster_id", "row", "col").agg(F.max((F.coalesce("value", F.lit(0)) != 0).cast("int")).alias("valid")).where("valid = 1").drop("valid")


def footprints(pixels: DataFrame, total: int) -> DataFrame:
    """Number, share (percent of ``total``) and window of each raster's valid pixels; rasters without any are dropped."""
    agg = [F.count("*").alias("n_valid"), *(f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max)))]
    return valid_pixels(pixels).groupBy("raster_id").agg(*agg).withColumn("percent", F.round(F.col("n_valid") * 100.0 / total, 4))


def stretch(pixels: DataFrame, how: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values as 0..255 by band: ``percentile`` (of positive values, exact), ``minmax`` (of positive values) or ``max`` (from 0).

    Invalid pixels are 255; a band without contrast gets a width of 1."""
    positive = pixels.where("value > 0").groupBy("raster_id", "band")
    if how == "percentile":
        p = F.percentile("value", F.array(F.lit(low), F.lit(high)))
        limits = positive.agg(p.alias("p")).select("raster_id", "band", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    elif how == "minmax":
        limits = positive.agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    else:
        limits = positive.agg(F.lit(0.0).alias("lo"), F.max("value").cast("double").alias("hi"))
    limits = limits.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    scaled = F.floor(F.least(F.greatest((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    out = pixels.join(limits, ["raster_id", "band"], "left")
    return out.select("raster_id", "row", "col", "band", F.when(F.col("value") > 0, scaled).otherwise(255).alias("shown"))


def mosaic(pixels: DataFrame, order: str = "raster_id") -> DataFrame:
    """The first valid value of each place and band, in the order of the rasters."""
    return pixels.where("value != 0").groupBy("row", "col", "band").agg(F.min_by("value", order).alias("value"), F.min(order).alias("source"))


def clipped(pixels: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Pixels whose centre lies in a zone (code, minx, miny, maxx, maxy), by zone; a zone without a valid pixel has no rows."""
    x, y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    inside = (x >= F.col("minx")) & (x < F.col("maxx")) & (y >= F.col("miny")) & (y < F.col("maxy"))
    # zones deal themselves out over the blocks they touch, so that pixels meet them by equality
    block = 64 * size
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block)))
    dealt = zones.withColumn("bx", over("minx", "maxx")).withColumn("by", over("miny", "maxy"))
    there = pixels.where("value != 0").withColumn("bx", F.floor(x / block)).withColumn("by", F.floor(y / block))
    return there.join(dealt, ["bx", "by"]).where(inside).drop("bx", "by", "minx", "miny", "maxx", "maxy")


def pyramid(pixels: DataFrame, factor: int) -> DataFrame:
    """Mean of the valid values of each factor x factor block."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.where("value != 0").groupBy("raster_id", "band", at("row"), at("col")).agg(F.avg("value").alias("value"))


def coverage(boxes: DataFrame, size: float, samples: int) -> DataFrame:
    """(row, col, coverage): how many of samples x samples sub-pixel centres of a pixel some box holds, from 1 on."""
    step = size / samples
    first = lambda c: F.ceil(F.col(c) / step - 0.5)
    last = lambda c: F.ceil(F.col(c) / step - 0.5) - 1
    over = boxes.withColumn("r0", first("miny")).withColumn("r1", last("maxy")).withColumn("c0", first("minx")).withColumn("c1", last("maxx")).where("r1 >= r0 and c1 >= c0")
    sub = over.select(F.explode(F.sequence("r0", "r1")).alias("sr"), "c0", "c1").select("sr", F.explode(F.sequence("c0", "c1")).alias("sc")).distinct()
    return sub.groupBy(F.floor(F.col("sr") / samples).cast("int").alias("row"), F.floor(F.col("sc") / samples).cast("int").alias("col")).agg(F.count("*").cast("int").alias("coverage"))


def coverage_histogram(cover: DataFrame) -> DataFrame:
    return cover.groupBy("coverage").agg(F.count("*").alias("pixels"))


def cutoff(histogram: DataFrame, target: int) -> DataFrame:
    """One row: the level at which pixels from the most covered down reach ``target``, and how many it must still give.

    When all pixels together are no more than the target, the level is 0 and nothing is left to give."""
    down = Window.orderBy(F.desc("coverage")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each level
    run = histogram.withColumn("upto", F.sum("pixels").over(down)).withColumn("before", F.col("upto") - F.col("pixels"))
    hit = run.where(F.col("upto") > target).agg(F.max("coverage").alias("level"), F.max_by(target - F.col("before"), "coverage").alias("need"))
    return hit.select(F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("need", F.lit(0)).cast("long").alias("need"))


def selected(cover: DataFrame, target: int, block: int = 512) -> DataFrame:
    """(row, col) of ``target`` pixels: all above the cutoff level, and at it a quota for each block, spread evenly within.

    Quotas are proportional by running counts over blocks in order, so they add up exactly."""
    at = cutoff(coverage_histogram(cover), target)
    cover = cover.crossJoin(F.broadcast(at))  # one row
    above = cover.where("coverage > level").select("row", "col")
    level = cover.where("coverage = level and need > 0").withColumn("block", F.struct(F.floor(F.col("row") / block).alias("y"), F.floor(F.col("col") / block).alias("x")))
    blocks = level.groupBy("block").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    run = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each block
    blocks = blocks.withColumn("upto", F.sum("c").over(run)).withColumn("total", F.sum("c").over(Window.partitionBy(F.lit(1))))
    blocks = blocks.withColumn("k", F.floor(F.col("upto") * F.col("need") / F.col("total")) - F.floor((F.col("upto") - F.col("c")) * F.col("need") / F.col("total")))
    picks = blocks.where("k > 0").select("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda i: F.floor((i + 0.5) * F.col("c") / F.col("k")))).alias("place"))
    placed = level.withColumn("place", (F.row_number().over(Window.partitionBy("block").orderBy("row", "col")) - 1).cast("bigint"))
    return above.union(placed.join(picks, ["block", "place"]).select("row", "col"))


def votes(pixels: DataFrame, parcels: DataFrame, size: float, background: int = 0, most_background: float = 0.5) -> DataFrame:
    """Each parcel's majority class among its pixels (ties to the smaller); background if it holds more than its share."""
    x, y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    cells = lambda a, b: F.explode(F.sequence(F.ceil(F.col(a) / size - 0.5), F.ceil(F.col(b) / size - 0.5) - 1))
    inside = parcels.where((F.ceil(F.col("maxx") / size - 0.5) > F.ceil(F.col("minx") / size - 0.5)) & (F.ceil(F.col("maxy") / size - 0.5) > F.ceil(F.col("miny") / size - 0.5)))
    hit = inside.withColumn("col", cells("minx", "maxx")).withColumn("row", cells("miny", "maxy")).join(pixels, ["row", "col"])
    counted = hit.groupBy("parcel_id", "class").agg(F.count("*").alias("n"))
    whole = counted.groupBy("parcel_id").agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("class") == background, F.col("n")).otherwise(0)).alias("empty"), F.max(F.when(F.col("class") != background, F.struct("n", (-F.col("class")).alias("c")))).alias("best"))
    kept = (F.col("empty") <= most_background * F.col("pixels")) & F.col("best").isNotNull()
    return whole.select("parcel_id", "pixels", F.when(kept, -F.col("best.c")).otherwise(background).cast("int").alias("class"), F.when(kept, F.col("best.n")).otherwise(F.col("empty")).alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: overall accuracy and kappa of the confusion counts."""
    c = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    marginal: Column = F.sum("n")
    t, p = c.groupBy("t").agg(marginal.alias("nt")), c.groupBy("p").agg(marginal.alias("np"))
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    chance = t.join(p, t["t"] == p["p"]).agg(F.coalesce(F.sum(F.col("nt") * F.col("np")), F.lit(0)).alias("chance"))
    both = total.crossJoin(F.broadcast(chance))  # one row each
    oa, pe = F.col("right") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(oa, 6).alias("accuracy"), F.round((oa - pe) / (1 - pe), 6).alias("kappa"))
