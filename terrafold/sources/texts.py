"""Text inputs: path lists in either encoding, control points, search products, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The bands wanted of an archive.
BANDS = ("B02", "B03", "B04", "B08")


def lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, line_no, line) of text lists: UTF-8 with or without a mark, else GB18030; quotes and blanks around
    lines go, empty lines are left out but counted."""

    @F.pandas_udf("string")
    def chinese(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode("gb18030", "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(chinese("content"))
    each = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace(text, "^\\uFEFF", ""), "\\r?\\n")).alias("n", "raw"))
    line = F.regexp_replace(F.trim("raw"), "^[\"']+|[\"']+$", "")
    return each.select("file", (F.col("n") + 1).cast("long").alias("line_no"), F.trim(line).alias("line")).where("line != ''")


def names(listed: DataFrame) -> DataFrame:
    """Lines that aren't comments."""
    return listed.where(~F.col("line").startswith("#"))


def control_points(listed: DataFrame) -> DataFrame:
    """(file, x0, y0, x1, y1, dx, dy) of files that hold exactly four finite numbers; others have nulls."""
    whole = listed.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], " ").alias("t"))
    parts = F.filter(F.split("t", "[,，;；\\s]+"), lambda x: x != "")
    n = F.transform(parts, lambda x: x.try_cast("double"))
    ok = (F.size("n") == 4) & F.forall("n", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = whole.withColumn("n", n).withColumn("n", F.when(ok, F.col("n")))
    cols = [F.get("n", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return out.select("file", *cols).withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))


def products(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, start, tile) of saved search answers; the tile comes from the attributes, else the name, else 未知."""
    raw = spark.read.schema("value array<struct<Id:string,Name:string,ContentDate:struct<Start:string>,Attributes:array<struct<Name:string,Value:string>>>>").option("multiLine", "true").json(path)
    p = raw.select(F.explode("value").alias("p")).select("p.*")
    told = F.get(F.filter("Attributes", lambda a: a["Name"] == "tileId"), F.lit(0))["Value"]
    named = F.nullif(F.regexp_extract("Name", r"_(T\d{2}[A-Z]{3})_", 1), F.lit(""))
    return p.select(F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("ContentDate.Start").alias("start"), F.coalesce(told, named, F.lit("未知")).alias("tile"))


def band_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, member) of the 10 m bands in archives; an archive that can't be read has a null band and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    members = zipfile.ZipFile(io.BytesIO(content)).namelist()
                except zipfile.BadZipFile as e:
                    rows.append((name, None, None, str(e)))
                    continue
                rows += [(name, band, m, None) for m in members for band in BANDS if "/IMG_DATA/R10m/" in m and m.endswith(f"_{band}_10m.jp2")]
            kinds = [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["path", "band", "member", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, band string, member string, error string")


def missing_bands(members: DataFrame) -> DataFrame:
    """(path, missing) of archives without all bands."""
    have = members.groupBy("path").agg(F.collect_set("band").alias("have"))
    return have.withColumn("missing", F.array_except(F.array(*map(F.lit, BANDS)), "have")).where(F.size("missing") > 0).select("path", "missing")
