"""File lists: what to copy, what is missing, what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions.names import stem


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row with ``occurrence`` (from 1) among those of its key, in the order given."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def adopted(files: DataFrame) -> DataFrame:
    """Files by name without regard to case: the first path is adopted, the others are duplicates of it."""
    by = Window.partitionBy(F.lower("name")).orderBy(F.lower("path"), "path")
    return files.withColumn("adopted", F.first("path").over(by)).withColumn("duplicate", F.row_number().over(by) > 1)


def unique_names(files: DataFrame, mark: str = "_重复") -> DataFrame:
    """A free target name for each file: the first of a name keeps it, the others get a number."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    base, ext = F.regexp_replace("name", r"(\.[^.]*)$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return files.withColumn("target", F.when(n == 1, F.col("name")).otherwise(F.concat(base, F.lit(mark), (n - 1).cast("string"), ext)))


def copy_plan(wanted: DataFrame, there: DataFrame, target: DataFrame) -> DataFrame:
    """Each wanted name (in any case) with its first source and what to do: missing, existing (same size there), conflict or copy."""
    source = there.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("path", "length")).alias("s"))
    done = target.groupBy(F.lower("name").alias("key")).agg(F.min("length").alias("t_length"))
    out = wanted.withColumn("key", F.lower("name")).join(source, "key", "left").join(done, "key", "left")
    action = F.when(F.col("s").isNull(), "missing").when(F.col("t_length").isNull(), "copy").when(F.col("t_length") == F.col("s.length"), "existing").otherwise("conflict")
    return out.select("name", F.col("s.path").alias("path"), F.col("s.length").alias("length"), action.alias("action"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two listings (rel_path, length, hash) by path without regard to case: same, only_left, only_right, size_differs or hash_differs."""
    a = left.select(F.lower("rel_path").alias("rel_path"), F.col("length").alias("l_length"), F.col("hash").alias("l_hash"))
    b = right.select(F.lower("rel_path").alias("rel_path"), F.col("length").alias("r_length"), F.col("hash").alias("r_hash"))
    status = F.when(F.col("r_length").isNull(), "only_left").when(F.col("l_length").isNull(), "only_right").when(F.col("l_length") != F.col("r_length"), "size_differs").when(F.col("l_hash") != F.col("r_hash"), "hash_differs").otherwise("same")
    return a.join(b, "rel_path", "full_outer").withColumn("status", status)


def towns_of(names: DataFrame, towns: DataFrame, size_bound: int = 100_000) -> DataFrame:
    """The longest town whose name a file's stem holds; null without one.

    Town names meet the stems' substrings of their lengths by equality, so nothing is compared with everything."""
    lengths = F.expr("sequence(1, length(stem))")
    stems = names.withColumn("stem", stem(F.col("name")))
    spans = towns.agg(F.coalesce(F.min(F.length("town")), F.lit(1)).alias("lo"), F.coalesce(F.max(F.length("town")), F.lit(0)).alias("hi")).first()
    parts = F.flatten(F.transform(lengths, lambda i: F.transform(F.sequence(F.lit(spans["lo"]), F.lit(max(spans["lo"], spans["hi"]))), lambda n: F.substring(F.col("stem"), i, n))))
    found = stems.select("name", F.explode(F.array_distinct(parts)).alias("town")).join(towns.select("town").distinct(), "town")
    best = found.groupBy("name").agg(F.max(F.struct(F.length("town").alias("n"), "town")).alias("b")).select("name", F.col("b.town").alias("town"))
    return names.join(best, "name", "left")


def with_sidecars(main: DataFrame, files: DataFrame) -> DataFrame:
    """Every file that shares folder and stem (in any case) with a main file, once, the main file first."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    keyed = lambda df: df.withColumn("folder", folder("path")).withColumn("key", F.lower(stem(F.col("path"))))
    wanted = keyed(main).select("folder", "key", F.col("path").alias("main"))
    out = keyed(files).join(wanted, ["folder", "key"]).select("main", "path", (F.col("path") != F.col("main")).alias("sidecar"))
    return out.distinct()
