"""Sample squares with a least distance: the greedy choice by priority, found in rounds over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import geometry as G
from terrafold.operators import overlay
from terrafold.operators.ranges import written


def spaced(points: DataFrame, key: str, spacing: float) -> DataFrame:
    """The points (key, id, x, y, priority) that a greedy choice keeps: in order of priority, then id, each that lies at
    least ``spacing`` from all kept before it, among those of its key.

    A round keeps every open point that comes before all its open neighbours and drops those near it, which gives the
    same choice; with priorities that are spread at random, rounds grow with the logarithm of the points. Neighbours meet in
    cells of the spacing's size; ids are unlike within a key. Points without coordinates are left out."""
    own = points.where("x is not null and y is not null").select(F.col(key).alias("_key"), "id", "x", "y", F.struct("priority", "id").alias("rank"))
    own = own.withColumns({"cx": F.floor(F.col("x") / spacing), "cy": F.floor(F.col("y") / spacing)})
    near = own.select("_key", F.col("id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("rank").alias("o_rank"), F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")).select("*", "c.*").drop("c")
    close = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) < spacing * spacing
    # (id, before): a neighbour that goes first
    before = written(own.join(near, ["_key", "cx", "cy"]).where((F.col("o_rank") < F.col("rank")) & close).select("_key", "id", F.col("o_id").alias("before")), "before")
    state = written(own.select("_key", "id", F.lit(None).cast("boolean").alias("kept")), "spaced")
    while state.where("kept is null").limit(1).count():
        first = state.select("_key", F.col("id").alias("before"), F.col("kept").alias("was"))
        seen = before.join(state.where("kept is null").select("_key", "id"), ["_key", "id"], "left_semi").join(first, ["_key", "before"])
        seen = seen.groupBy("_key", "id").agg(F.max(F.coalesce("was", F.lit(False))).alias("beside"), F.max(F.col("was").isNull()).alias("waits"))
        told = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beside"), False).when(F.coalesce("waits", F.lit(False)), None).otherwise(True)
        state = written(state.join(seen, ["_key", "id"], "left").select("_key", "id", told.alias("kept")), "spaced")
    kept = state.where("kept").select(F.col("_key").alias(key), "id")
    return points.join(kept, [key, "id"], "left_semi")


def sample_squares(zones: DataFrame, key: str, n: int, side: float, spacing: float, least_share: float) -> DataFrame:
    """(key, id, x, y, place): up to ``n`` squares a zone (key, rings), numbered from 1 by hashed priority.

    Candidates are the squares of a regular grid of which at least ``least_share`` lies in the zone; their middles
    (x, y) are at least ``spacing`` apart. The same zones give the same squares, in any order of rows."""
    box = zones.where(F.size("rings") > 0).select(F.col(key).alias("_zone"), G.bounds(F.col("rings")).alias("b"))
    steps = lambda low, high: F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))
    cells = box.withColumn("gx", F.explode(steps("b.minx", "b.maxx"))).withColumn("gy", F.explode(steps("b.miny", "b.maxy")))
    cells = cells.select("_zone", F.concat_ws("_", "gx", "gy").alias("id"), ((F.col("gx") + 0.5) * side).alias("x"), ((F.col("gy") + 0.5) * side).alias("y"), F.xxhash64(F.col("_zone").cast("string"), "gx", "gy").alias("priority"))
    half = side / 2
    squares = cells.select("id", F.array(G.box(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)).alias("rings")).dropDuplicates(["id"])
    share = overlay.shared_area(squares, zones.select(F.col(key).alias("_zone"), "rings"), 8 * side, "id", "_zone").where(F.col("area") >= least_share * side * side - 1e-9)
    good = written(cells.join(share.select("id", "_zone"), ["id", "_zone"], "left_semi"), "candidates")
    place = F.row_number().over(Window.partitionBy("_zone").orderBy("priority", "id"))
    chosen = spaced(good, "_zone", spacing).withColumn("place", place).where(F.col("place") <= n)
    return chosen.select(F.col("_zone").alias(key), "id", "x", "y", "place")


def clipped_truth(truth: DataFrame, squares: DataFrame, truth_key: str, key: str, side: float) -> DataFrame:
    """(key, id, truth_key, area): what of each true shape (truth_key, rings) lies in each chosen square."""
    half = side / 2
    own = squares.select(F.col(key).alias("_zone"), "id", F.concat_ws("|", F.col(key).cast("string"), "id").alias("square"), F.array(G.box(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)).alias("rings"))
    area = overlay.shared_area(own.select("square", "rings"), truth, 8 * side, "square", truth_key)
    return area.join(own.select("_zone", "id", "square"), "square").select(F.col("_zone").alias(key), "id", truth_key, "area")
