"""Lookups, upserts, routing and reports over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one of the highest order; on equal order the new one. An aggregate, so no sort."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r"))
    return best.select(key, *(F.col("r")[c].alias(c) for c in rest))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't listed: deletes, and jobs whose output isn't there yet."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def wanted_in_order(wanted: DataFrame, available: DataFrame, key: str, order: str) -> DataFrame:
    """What is wanted and available, each once, at its first place."""
    first = wanted.groupBy(key).agg(F.min(order).alias(order))
    return first.join(available.select(key).distinct(), key, "left_semi")


def by_code(files: DataFrame, regions: DataFrame, digits: int = 6) -> DataFrame:
    """Files by the code that their name begins with: matched, unknown (no such region) or invalid (no code)."""
    code = F.nullif(F.regexp_extract("name", rf"^(\d{{{digits}}})_", 1), F.lit(""))
    out = files.withColumn("code", code).join(regions.withColumnRenamed("county_code", "code"), "code", "left")
    return out.withColumn("status", F.when(F.col("code").isNull(), "invalid").when(F.col("county_name").isNull(), "unknown").otherwise("matched"))


def best_name(wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of each wanted name: the same name first, else one that holds it, then the smallest code.

    Names meet all their own beginnings-to-ends by equality instead of being compared with each other."""
    parts = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("county_name")), lambda i: F.transform(F.sequence(F.lit(1), F.length("county_name") - i + 1), lambda n: F.substring(F.col("county_name"), i, n))))))
    held = regions.select("county_code", "county_name", parts.alias("wanted"))
    hit = wanted.join(held, "wanted").groupBy("wanted").agg(F.min(F.struct((F.col("county_name") != F.col("wanted")).alias("loose"), "county_code", "county_name")).alias("b"))
    return wanted.join(hit, "wanted", "left").select("wanted", F.col("b.county_code").alias("county_code"), F.col("b.county_name").alias("county_name"))


def filled_down(rows: DataFrame, column: str, group: str, order: str) -> DataFrame:
    """Nulls take the last value above them in their group, as merged cells do."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def newest(rows: DataFrame, order: list[Column], n: int, least: int = 1, most: int = 100) -> DataFrame:
    """The first n rows, n held between ``least`` and ``most``."""
    return rows.orderBy(*order).limit(max(least, min(n, most)))


def complete(members: DataFrame, key: str, item: str, needed: list[str]) -> DataFrame:
    """Each key with what it lacks of the needed items, sorted; and whether it has all."""
    have = members.groupBy(key).agg(F.collect_set(item).alias("have"))
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "have"))
    return have.select(key, F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("complete"))


def stacked(pixels: DataFrame, bands: list) -> DataFrame:
    """One row a place with a column for each band."""
    return pixels.groupBy("raster_id", "row", "col").pivot("band", bands).agg(F.first("value"))


def kept_by_largest(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of overlapping parcels, the area each loses: an overlap belongs to the larger one (on equal areas, to the smaller id)."""
    size = parcels.select("parcel_id", ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("size"))
    a = pairs.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
    loser = F.when(F.col("size_a") >= F.col("size_b"), F.col("b")).otherwise(F.col("a"))
    return a.groupBy(loser.alias("parcel_id")).agg(F.sum("area").alias("lost_m2"), F.count("*").alias("overlaps"))


def summary_lines(totals: DataFrame) -> DataFrame:
    """City totals as they are written: mu with six decimals, square metres with four."""
    mu = F.format_string("%.6f", F.bround(F.col("area_m2") * 0.0015, 6))
    return totals.select("city_code", mu.alias("area_mu"), F.format_string("%.4f", F.col("area_m2").cast("double")).alias("area_m2"), "files", "hits")


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
