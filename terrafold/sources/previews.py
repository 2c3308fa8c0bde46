"""Previews of result files: tables, JSON and texts, each as one row with what is shown and whether that is all."""

from __future__ import annotations

import csv
import io
import json
import mimetypes

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# How much a preview shows, and what counts as text.
ROWS, CHARACTERS, BYTES, HEAD = 500, 300_000, 2 * 1024 * 1024, 8192
KNOWN = ".py .js .jsx .ts .tsx .html .css .scss .json .md .txt .toml .yaml .yml .xml .sh .ini .cfg .conf .lock .csv .gitignore".split()
#: These, and what else is a text by its usual type.
TEXTS = sorted({*KNOWN, *(s for s, kind in mimetypes.MimeTypes().types_map[True].items() if kind.startswith("text/"))})

_TABLE = StructType([StructField("headers", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType()))), StructField("truncated", BooleanType())])
_TEXT = StructType([StructField("content", StringType()), StructField("truncated", BooleanType())])


def _read(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


@F.pandas_udf(_TABLE)
def _table(content: pd.Series) -> pd.DataFrame:
    out = []
    for raw in content:
        shown = [row for row, _ in zip(csv.reader(io.StringIO(_read(raw), newline="")), range(ROWS + 1), strict=False)]
        out.append((shown[0] if shown else [], shown[1:], len(shown) > ROWS))
    return pd.DataFrame(out, columns=["headers", "rows", "truncated"])


@F.pandas_udf(_TEXT)
def _json(content: pd.Series) -> pd.DataFrame:
    out = []
    for raw in content:
        text = _read(raw)
        try:
            text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except json.JSONDecodeError:
            pass
        out.append((text[:CHARACTERS], len(text) > CHARACTERS))
    return pd.DataFrame(out, columns=["content", "truncated"])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, headers, rows, truncated) of .csv files: UTF-8 with or without a mark, else GB18030; the first 500 rows.

    ``truncated`` is true from 500 rows on, as the header counts among what was read."""
    return _files(spark, path, "*.[cC][sS][vV]").withColumn("t", _table("content")).select("path", "name", "t.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, truncated) of .json files, set out by levels; what is no JSON is shown as it is."""
    return _files(spark, path, "*.[jJ][sS][oO][nN]").withColumn("t", _json("content")).select("path", "name", "t.*")


def _known(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*TEXTS)


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, previewable, content): files of at most 2 MiB with a known suffix and no zero byte at the head."""
    files = _files(spark, path, glob)
    fit = (F.col("length") <= BYTES) & _known(F.col("name"))
    zero = F.hex(F.substring("content", 1, HEAD)).rlike("^(?:..)*?00")
    shown = fit & ~zero
    return files.select("path", "name", F.col("length").alias("size"), shown.alias("previewable"), F.when(shown, F.make_valid_utf8(F.col("content").cast("string"))).alias("content"))
