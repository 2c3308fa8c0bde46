"""Slivers merged into the neighbour they share most border with, along chains, until none is left beside another shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import overlay
from terrafold.operators.ranges import written
from terrafold.operators.spatial import box_join


def borders(shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """(a, b, length) of shapes (key, rings) that lie side by side, a < b: how much of their sides runs along one line.

    Sides meet in cells and need not have the same ends. Points in which shapes touch are no border."""
    sides = overlay.sides_of(shapes.select(F.col(key).alias("id"), "rings"))
    boxed = sides.withColumns({"minx": F.least("ax", "bx"), "miny": F.least("ay", "by"), "maxx": F.greatest("ax", "bx"), "maxy": F.greatest("ay", "by")})
    pairs = box_join(boxed, boxed, cell, keep_touching=True).where("id < r_id")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt(dx * dx + dy * dy)
    off = lambda x, y: F.abs(dx * (F.col(y) - F.col("ay")) - dy * (F.col(x) - F.col("ax"))) <= 1e-6 * size
    along = lambda x, y: (dx * (F.col(x) - F.col("ax")) + dy * (F.col(y) - F.col("ay"))) / size
    one, two = along("r_ax", "r_ay"), along("r_bx", "r_by")
    shared = F.least(size, F.greatest(one, two)) - F.greatest(F.lit(0.0), F.least(one, two))
    met = pairs.where(off("r_ax", "r_ay") & off("r_bx", "r_by")).select(F.col("id").alias("a"), F.col("r_id").alias("b"), shared.alias("length")).where("length > 1e-6")
    return met.groupBy("a", "b").agg(F.sum("length").alias("length"))


def absorbed(areas: DataFrame, beside: DataFrame, least: float) -> DataFrame:
    """(id, root): the shape that takes each one in, itself if none does.

    ``areas``: (id, area), ``beside``: (a, b, length). In a round each group under ``least`` points at the neighbour with
    the longest common border (ties by the pair's ids). Two that point at each other are led by the larger one, then the
    lesser id; so pointers end at a leader, and following two at once finds it in few steps. Groups are then summed up, and rounds
    go on while a group under ``least`` has a neighbour."""
    roots = written(areas.select("id", F.col("id").alias("root")), "roots")
    own = areas.select("id", "area")
    while True:
        groups = written(roots.join(own, "id").groupBy("root").agg(F.sum("area").alias("area")), "groups")
        lead = roots.select(F.col("id"), F.col("root"))
        near = beside.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").where("x != y")
        near = near.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("length").alias("length"))
        both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "length"))
        small = groups.where(F.col("area") < least).select(F.col("root").alias("x"), F.col("area"))
        order = F.struct("length", (-F.least("x", "y")).alias("low"), (-F.greatest("x", "y")).alias("high"))
        to = written(both.join(small, "x").groupBy("x").agg(F.max_by("y", order).alias("to"), F.first("area").alias("area")), "pointers")
        if not to.limit(1).count():
            return roots
        back = to.select(F.col("x").alias("to"), F.col("to").alias("back"), F.col("area").alias("their"))
        leads = (F.col("back") == F.col("x")) & ((F.col("area") > F.col("their")) | ((F.col("area") == F.col("their")) & (F.col("x") < F.col("to"))))
        steps = to.join(back, "to", "left").select("x", F.when(F.coalesce(leads, F.lit(False)), F.col("x")).otherwise(F.col("to")).alias("to"))
        steps = written(steps, "steps")
        while True:
            ahead = steps.select(F.col("x").alias("to"), F.col("to").alias("next"))
            new = steps.join(ahead, "to", "left").select("x", F.coalesce("next", "to").alias("to"), (F.coalesce("next", "to") != F.col("to")).alias("moved"))
            new = written(new, "steps")
            steps = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
        roots = written(roots.join(steps.withColumnRenamed("x", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")


def merged(shapes: DataFrame, key: str, least: float, cell: float) -> DataFrame:
    """(key, area, parts, rings): shapes (key, rings) after slivers under ``least`` have gone into their neighbours.

    A merged shape has the id of the one that took the others in. Shapes that were not part of any merging keep their
    rings. A sliver without a neighbour stays. Ids are whole numbers, unlike each other."""
    own = shapes.select(F.col(key).alias("id"), "rings").where(F.size("rings") > 0)
    areas = own.select("id", G.polygon_area(F.col("rings")).alias("area"))
    roots = absorbed(areas, written(borders(own, "id", cell), "borders"), least)
    parts = roots.join(areas, "id").groupBy("root").agg(F.count("*").alias("parts"), F.sum("area").alias("area"))
    groups = roots.join(parts.where("parts > 1"), "root").join(own, "id")
    rings = overlay.dissolved(groups.select("root", F.col("id").alias("gid"), F.lit(0).alias("side"), "rings"), ["root"], 16 * cell)
    new = rings.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring_id", "ring"))), lambda r: r["ring"]).alias("rings"))
    alone = parts.where("parts = 1").join(own.withColumnRenamed("id", "root"), "root").select("root", "area", "parts", "rings")
    return alone.unionByName(parts.join(new, "root").select("root", "area", "parts", "rings")).withColumnRenamed("root", key)
