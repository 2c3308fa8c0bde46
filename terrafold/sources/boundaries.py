"""Boundary layers read from files, checked, projected, repaired and dissolved; listings of what can be read.

Problems are rows with a reason, so that one bad layer neither stops the others nor goes unseen; ``refused`` turns them
into an error where a tool must stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions.names import numeric_code, region_name
from terrafold.operators import overlay
from terrafold.operators.rules import said
from terrafold.sources import shapefile

# What vector files are called.
VECTORS = (".shp", ".geojson", ".json")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^file:/+", "/")


def files(spark: SparkSession, path: str, suffixes: Sequence[str], recursive: bool = True, without: str | None = None, limit: int = 0) -> DataFrame:
    """(path, name, folder, length) of files with one of the suffixes (in any case), by path; ``path`` may be one file.

    ``folder`` is the first one below the path, null for files at the top. Files below ``without`` are left out; with a
    ``limit`` over 0 only the first ones are kept. A path without any gives an empty table."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.lower("path").endswith(s.lower())
    base = "/" + path.removeprefix("file:").strip("/")
    inner = F.split(F.substring(_bare(F.col("path")), len(base) + 2, 1 << 20), "/")
    out = found.where(ends & ~name.startswith(".")).select("path", name.alias("name"), F.when(F.size(inner) > 1, inner[0]).alias("folder"), "length")
    if without:
        out = out.where(~_bare(F.col("path")).startswith("/" + without.removeprefix("file:").strip("/") + "/"))
    out = out.orderBy(F.lower("path"), "path")
    return out.limit(limit) if limit > 0 else out


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector files at a path, in order."""
    return files(spark, path, VECTORS)


def refused(found: DataFrame, what: str) -> DataFrame:
    """The table itself; an error, once it is read, if it has no row."""
    n = found.agg(F.count("*").alias("_n"))
    bad = n.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(what))).isNotNull().alias("bad")).where("bad")
    none = bad.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema))
    return found.unionByName(none)


def systems(spark: SparkSession, path: str) -> DataFrame:
    """(layer, crs, name, albers) of each .prj: its text, the system's name, and whether it is an Albers projection."""
    prj = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][rR][jJ]").load(path)
    text = F.nullif(F.trim(F.make_valid_utf8(F.col("content").cast("string"))), F.lit(""))
    out = prj.select(_layer(F.col("path")).alias("layer"), text.alias("crs"))
    return out.select("layer", "crs", F.nullif(F.regexp_extract("crs", r'^\s*\w+\s*\[\s*"([^"]*)"', 1), F.lit("")).alias("name"), F.lower("crs").contains("albers").alias("albers"))


def _layer(path: Column) -> Column:
    """What the files of a layer have in common."""
    return F.lower(F.regexp_replace(_bare(path), r"\.[^./]+$", ""))


def same_system(a: Column, b: Column) -> Column:
    """Whether two texts name one system: blanks, case, axes and authority codes don't count."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r'(?i),\s*(axis|authority|id)\s*\[("[^"]*"|[^\[\]"]|\[[^\]]*\])*\]', ""), r"\s+", ""))
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def layer_checks(features: DataFrame, crs: DataFrame, fields: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """(layer, features, error) of each layer: its first fault, null if there is none.

    ``features`` as ``shapefile.features`` tells, ``crs`` as ``systems``. Faults: 'missing' (expected (layer) but not there), what a
    reader said, 'empty', 'field x is missing', 'no system'. A field is there if the layer has it, with values or not."""
    rows = features.withColumn("layer", _layer(F.col("source_file")))
    has = [F.max(F.coalesce(F.map_contains_key("attributes", F.lit(f)), F.lit(False))).alias(f"f{k}") for k, f in enumerate(fields)]
    told = rows.groupBy("layer").agg(F.count_if(F.col("kind") > 0).alias("features"), F.max(F.when(F.col("kind") == -1, F.col("attributes")["error"])).alias("said"), *has)
    told = told.join(crs.select("layer", "crs"), "layer", "left").withColumn("there", F.lit(True))
    if expected is not None:
        told = expected.select(F.lower("layer").alias("layer")).distinct().join(told, "layer", "full")
    error = F.when(F.col("there").isNull(), "missing").when(F.col("said").isNotNull(), F.col("said")).when(F.col("features") == 0, "empty")
    for k, f in enumerate(fields):
        error = error.when(~F.col(f"f{k}"), f"field {f} is missing")
    return told.select("layer", F.coalesce("features", F.lit(0)).alias("features"), error.when(F.col("crs").isNull(), "no system").alias("error"))


def boundaries(features: DataFrame, name: str, code: str | None = None, digits: int = 4) -> DataFrame:
    """(layer, feature_no, name, plain_name, code, rings): features with an area and a name, of any layer.

    ``plain_name`` lacks the ending of its kind. With a ``code`` field, features whose code hasn't the digits are left out."""
    own = features.where(F.size("rings") > 0).select(_layer(F.col("source_file")).alias("layer"), "feature_no", said(F.col("attributes")[name]).alias("name"), (numeric_code(F.col("attributes")[code], digits) if code else F.lit(None).cast("string")).alias("code"), "rings")
    own = own.where("name is not null" + (f" and length(code) = {digits}" if code else ""))
    return own.select("layer", "feature_no", "name", region_name(F.col("name")).alias("plain_name"), "code", "rings")


def attributes(features: DataFrame, *fields: str) -> DataFrame:
    """(layer, feature_no, fields): attributes alone; the plan reads no geometry column."""
    return features.select(_layer(F.col("source_file")).alias("layer"), "feature_no", *(said(F.col("attributes")[f]).alias(f) for f in fields))


def in_degrees(bounds: DataFrame, crs: DataFrame, albers: G.Albers) -> DataFrame:
    """Boundaries (layer, rings, ...) of Albers layers brought to degrees; others, said to be in degrees, stay."""
    kinds = crs.select("layer", "albers")
    rings = F.when(F.coalesce("albers", F.lit(False)), G.reprojected(F.col("rings"), albers.inverse)).otherwise(F.col("rings"))
    return bounds.join(kinds, "layer", "left").withColumn("rings", rings).drop("albers")


def dissolved(bounds: DataFrame, keys: list[str], tile: float, albers: G.Albers | None = None) -> DataFrame:
    """(keys, hole, area, ring): boundaries (keys, rings in degrees, or metres without ``albers``) projected, repaired and united by key.

    Without keys everything becomes one boundary, as of a province or a region of interest."""
    rings = G.reprojected(F.col("rings"), albers.forward) if albers else F.col("rings")
    shapes = bounds.select(*keys, F.xxhash64("rings").alias("gid"), F.lit(0).alias("side"), rings.alias("rings"), *([] if keys else [F.lit(1).alias("_all")]))
    return overlay.dissolved(shapes, keys or ["_all"], tile).drop("ring_id", "_all")


def roi(spark: SparkSession, path: str | None = None, box: tuple[float, float, float, float] | None = None, tile: float = 1.0) -> DataFrame:
    """(hole, area, ring): a region of interest in its own units, from a file's layers or a box; an error if it is neither or empty."""
    if box:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
        bounds = spark.range(1).select(F.array(G.box(x0, y0, x1, y1)).alias("rings"))
    elif path:
        bounds = shapefile.features(spark, path).select("rings")
    else:
        raise ValueError("give a file or a box")
    return refused(dissolved(bounds, [], tile), "the region of interest is empty")
