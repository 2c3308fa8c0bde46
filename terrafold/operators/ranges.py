"""Order over a whole table by ranges of keys, so that no task holds all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``. Only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read again, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the number of their ``range`` in the order of keys: later ranges have no smaller keys.

    There are as many ranges as shuffle partitions. Rows of equal keys may lie in several ranges, so a key that many
    rows share is split. The table is written once below ``spark.checkpoint.dir`` (a local master may do without one),
    as ranges come from a sample and must stay the same for all who read them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "tie")
    out = out.drop("tie").withColumn("range", F.spark_partition_id())
    return written(out, "ranges")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with their number (long, from 0) in the order of ``key``, nulls first; equal keys in any order."""
    parts = ranged(rows, key)
    sizes = parts.groupBy("range").count()  # a row for each range
    before = F.sum("count").over(Window.orderBy("range")) - F.col("count")
    sizes = sizes.select("range", before.alias("before"))
    mine = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return parts.withColumn("mine", mine).join(sizes, "range").withColumn(name, F.col("before") + F.col("mine")).select(*rows.columns, name)
