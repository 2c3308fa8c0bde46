"""Scenes: grouping by day and satellite, matching to regions, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.names import product, sensing_time
from terrafold.operators.spatial import box_join, unique_area


def parsed(files: DataFrame) -> DataFrame:
    """Files whose name is a full product name, with its fields, sensing time and day; others are left out."""
    out = files.withColumn("p", product(F.col("name"))).where("p.satellite is not null").select(*files.columns, "p.*")
    return out.withColumn("sensing_ts", sensing_time(F.col("sensing"))).withColumn("day", F.substring("sensing", 1, 8))


def grouped(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted paths of each group, their number, and the name prefix: the only one, else MULTI."""
    out = scenes.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("scenes"), F.collect_set("tile").alias("tiles"))
    return out.withColumn("label", F.when(F.size("tiles") == 1, F.col("tiles")[0]).otherwise("MULTI")).drop("tiles")


def by_region(scenes: DataFrame, regions: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Paths of the scenes over each region, by further columns of the scenes."""
    pairs = box_join(scenes, regions, cell)
    return pairs.groupBy("city_code", *keys).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.countDistinct("path").alias("scenes"))


def covered(scenes: DataFrame, regions: DataFrame, cell: float, by: list[str] | None = None) -> DataFrame:
    """Percent of each region that scenes cover together, 0 to 100, and the area that is missing.

    With ``by``, for the scenes of each group that has any over the region."""
    by = by or []
    pairs = box_join(scenes.select(*by, "minx", "miny", "maxx", "maxy"), regions, cell)
    cut = pairs.select(*by, "city_code", F.greatest("minx", "r_minx").alias("minx"), F.greatest("miny", "r_miny").alias("miny"), F.least("maxx", "r_maxx").alias("maxx"), F.least("maxy", "r_maxy").alias("maxy"))
    have = unique_area(cut, [*by, "city_code"], cell)
    whole = regions.groupBy("city_code").agg(F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("whole"))
    out = whole.join(have, "city_code", "inner" if by else "left").withColumn("have", F.coalesce("unique_area_m2", F.lit(0.0)))
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("have") / F.col("whole") * 100))
    return out.select(*by, "city_code", F.round(percent, 4).alias("percent"), F.round(F.greatest(F.col("whole") - F.col("have"), F.lit(0.0)), 4).alias("missing_m2"))
