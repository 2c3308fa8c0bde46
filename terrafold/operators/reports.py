"""Checked boundary tables, name rules and status reports over plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checked_counties(rows: DataFrame, name: str, code: str, digits: int = 6) -> DataFrame:
    """Counties with county_code (the first ``digits`` of the code), city_code (its first 4) and whether both hold; null and blank names fail."""
    plain = F.regexp_replace(F.trim(F.col(code)), r"\.0+$", "")
    ok = plain.rlike(rf"^\d{{{digits}}}") & (F.trim(F.coalesce(name, F.lit(""))) != "")
    return rows.withColumn("county_code", F.when(ok, F.substring(plain, 1, digits))).withColumn("city_code", F.when(ok, F.substring(plain, 1, 4))).withColumn("valid", F.coalesce(ok, F.lit(False)))


def first_bad(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows that failed a check, for its message."""
    return rows.where(~F.col("valid")).orderBy(by).limit(n)


def with_city(counties: DataFrame, cities: DataFrame) -> DataFrame:
    """(county_code, county_name, city_name, error): counties with the name of the city whose code theirs begins with, one row a code.

    A code that stands for several counties, or whose city has several names, has the least names and says so as
    ``error``. A county without a city, and blank names and codes, are left out."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    named = cities.where(said("city_code") & said("city_name")).groupBy("city_code").agg(F.min(F.trim("city_name")).alias("city_name"), F.max(F.trim("city_name")).alias("_city"))
    own = counties.where(said("county_code") & said("county_name")).groupBy("county_code", "city_code").agg(F.min(F.trim("county_name")).alias("county_name"), F.max(F.trim("county_name")).alias("_county"))
    error = F.when(F.col("county_name") != F.col("_county"), F.concat_ws(" / ", "county_name", "_county")).when(F.col("city_name") != F.col("_city"), F.concat_ws(" / ", "city_name", "_city"))
    return own.join(named, "city_code").select("county_code", "county_name", "city_name", error.alias("error"))


def at_level(wanted: DataFrame, cities: DataFrame, counties: DataFrame) -> DataFrame:
    """Each wanted name (name) with its code: of the city layer first, else of the county layer; level says which, or 'none'."""
    one = lambda df, code: df.groupBy("name").agg(F.min("code").alias(code))
    out = wanted.join(one(cities, "city"), "name", "left").join(one(counties, "county"), "name", "left")
    level = F.when(F.col("city").isNotNull(), "city").when(F.col("county").isNotNull(), "county").otherwise("none")
    return out.select("name", F.coalesce("city", "county").alias("code"), level.alias("level"))


def looked_up(rows: DataFrame, column: str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """The value of a fixed dictionary (a constant of the plan, of a size known before); ``default`` for other keys."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.element_at(table, rows[column]), F.lit(default))


def representatives(products: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the product of the first sensing time, then prefix; and whether the group has several prefixes."""
    first = F.min(F.struct("sensing", "prefix")).alias("r")
    out = products.groupBy(*keys).agg(first, F.min("prefix").alias("low"), F.max("prefix").alias("high"))
    return out.select(*keys, F.col("r.sensing").alias("sensing"), F.col("r.prefix").alias("prefix"), (F.col("low") != F.col("high")).alias("mixed"))


def town_stats(lines: DataFrame, per_image: int = 5) -> DataFrame:
    """By town: lists, lines, distinct images, repeated lines, and the files expected for the images."""
    out = lines.groupBy("town").agg(F.countDistinct("txt").alias("lists"), F.count("*").alias("lines"), F.countDistinct("image").alias("images"))
    return out.withColumn("repeated", F.col("lines") - F.col("images")).withColumn("expected", F.col("images") * per_image)


def folder_sizes(files: DataFrame) -> DataFrame:
    """By top folder: files, bytes, GiB and GB."""
    top = F.regexp_extract("path", "^/?([^/]+)/", 1).alias("folder")
    out = files.groupBy(top).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return out.withColumn("gib", F.round(F.col("bytes") / 2.0**30, 6)).withColumn("gb", F.round(F.col("bytes") / 1e9, 6))


def numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (one row each) with their index and the total, as in 3/40; the table is one of groups, not of their rows."""
    w = Window.orderBy(*keys)
    total = groups.agg(F.count("*").alias("total"))
    out = groups.withColumn("index", F.row_number().over(w)).crossJoin(F.broadcast(total))  # with a one-row table
    return out.withColumn("label", F.concat_ws("/", F.col("index").cast("string"), F.col("total").cast("string")))


def stacked_layers(layers: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of the layers with their _source_file and its place; columns that a layer lacks are null."""
    out = None
    for k, (name, df) in enumerate(layers.items()):
        one = df.withColumn("_source_file", F.lit(name)).withColumn("_source_no", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by ``order``; an aggregate, so no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in order; all of them if n is 0."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def detail_lines(hits: DataFrame, files: DataFrame, failed: DataFrame, unread: DataFrame) -> DataFrame:
    """One line for each file and city with area, one for each file without a hit, each failed file, and each path that couldn't be read."""
    line = lambda df, status: df.select("source_file", "city_code", "area_m2", F.lit(status).alias("status"))
    none = lambda df: df.withColumn("city_code", F.lit(None).cast("string")).withColumn("area_m2", F.lit(None).cast("double"))
    bare = files.join(hits.select("source_file").distinct(), "source_file", "left_anti").join(failed.select("source_file"), "source_file", "left_anti")
    return line(hits, "ok").unionByName(line(none(bare), "no_hit")).unionByName(line(none(failed), "failed")).unionByName(line(none(unread), "scan_error"))


def area_report(sums: DataFrame) -> DataFrame:
    """One row: the report's text from one row of features, area_m2 and unique_m2."""
    text = F.format_string("features: %d\narea_m2: %.2f\narea_mu: %.4f\nunique_m2: %.2f", "features", "area_m2", F.col("area_m2") * 0.0015, "unique_m2")
    return sums.select(text.alias("report"))


def comparison_report(sums: DataFrame, samples: int = 8, foreground: int = 255, keep: Sequence[str] = ()) -> DataFrame:
    """The report that compares a raster with its vectors, for each row of features, skipped, unique_m2 and raster_m2, with the columns to ``keep``.

    The share is nan without a vector area; the line of skipped features is there only if some were."""
    # The report's wording.
    d = F.col("raster_m2") - F.col("unique_m2")
    share = F.when(F.col("unique_m2") > 0, F.format_string("%.6f", F.bround(F.abs(d) / F.col("unique_m2") * 100, 6))).otherwise("nan")
    m2 = lambda c: F.format_string("%,.3f m²", F.bround(c, 3))  # noqa: E731  half-way values go to the even digit
    lines = [
        F.lit("中稻 0809 地块掩膜面积对比报告"),
        F.lit("=" * 42),
        F.format_string("合并面要素数: %,d", "features"),
        F.when(F.col("skipped") > 0, F.format_string("跳过的空/非面要素数: %,d", "skipped")),
        F.lit(f"栅格化规则: {samples}×{samples} 超采样，按覆盖率排序并约束总面积"),
        F.lit("标称分辨率: 10 m × 10 m"),
        F.lit(""),
        F.concat(F.lit("矢量净覆盖面积（重叠只算一次）: "), m2(F.col("unique_m2"))),
        F.concat(F.lit(f"TIFF 值为 {foreground} 区域面积: "), m2(F.col("raster_m2"))),
        F.concat(F.lit("面积差（TIFF - 矢量）: "), m2(d)),
        F.concat(F.lit("差异比例（相对矢量）: "), share, F.lit("%")),
        F.lit(""),
        F.lit("说明：面积均在内存中转换到 Albers 等面积投影计算；矢量重叠部分只算一次。"),
    ]
    return sums.select(*keep, F.concat(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n")).alias("report"))


def shown_in_tree(nodes: DataFrame) -> DataFrame:
    """Nodes (parent, name, is_file) with their place in the parent: folders first, then by name in any case."""
    w = Window.partitionBy("parent").orderBy("is_file", F.lower("name"), "name")
    return nodes.withColumn("place", F.row_number().over(w))


def reserved_pixels(parcels: DataFrame, resolution: float, width: int, height: int) -> DataFrame:
    """The distinct pixels that hold the middle of each parcel's box, kept within the raster."""
    at = lambda low, high, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(low) + F.col(high)) / 2 / resolution))).cast("int")
    return parcels.select(at("miny", "maxy", height).alias("row"), at("minx", "maxx", width).alias("col")).distinct()


def crop_window(minx: Column, miny: Column, maxx: Column, maxy: Column, resolution: float, width: int, height: int) -> Column:
    """struct(col, row, width, height) of a box's pixels within the raster; null ('no coverage') if there are none."""
    c0, r0 = F.greatest(F.lit(0), F.floor(minx / resolution)), F.greatest(F.lit(0), F.floor(miny / resolution))
    c1, r1 = F.least(F.lit(width), F.ceil(maxx / resolution)), F.least(F.lit(height), F.ceil(maxy / resolution))
    window = F.struct(c0.cast("int").alias("col"), r0.cast("int").alias("row"), (c1 - c0).cast("int").alias("width"), (r1 - r0).cast("int").alias("height"))
    return F.when((c1 > c0) & (r1 > r0), window)
