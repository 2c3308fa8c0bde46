"""Helpers that the training-data operators share: scratch tables, text access and linked components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``. Only a local master may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read again.

    It cuts the lineage, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str | None = None) -> None:
    """Fewer rows, and bytes if asked for, are handed to Python at once, as texts may be long; a session that asks for fewer rows keeps its number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slot_bits(keys: int) -> int:
    """High bits that tell the slots of a filter of so many keys apart: 16 slots a key or more, and a table of 16 MB at most."""
    return min(27, max(20, (16 * keys).bit_length()))


def slot_filter(keys: DataFrame, high: int) -> np.ndarray:
    """A bit for each slot of ``2**high`` in which some ``key`` falls; made in blocks on the executors, 16 MB in all.

    It grows with the keys up to its bound; beyond that it only keeps less from being shuffled."""
    slot = F.shiftrightunsigned("key", 64 - high)
    slots = keys.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 15).cast("int").alias("block")).agg(F.collect_list(F.col("slot").bitwiseAND(F.lit(32767))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for at in b.column(1):
                bits = np.zeros(1 << 15, bool)
                bits[at.values.to_numpy()] = True
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["block", "bits"])

    out = np.zeros((1 << (high - 15), 1 << 12), np.uint8)
    for r in slots.mapInArrow(run, "block int, bits binary").collect():  # at most 4096 rows
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_slots(wanted: np.ndarray, key: np.ndarray, high: int) -> np.ndarray:
    slot = (key >> np.uint64(64 - high)).astype(np.int64)
    return (wanted[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long), as (node, component): the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes; each step is a shuffle of the
    edges, and a node with very many neighbours keeps only its edge to the smallest one after a step.
    Nodes without an edge are not returned; self-loops and nulls are ignored."""
    edges = written(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u != v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        edges.select("v", "v").distinct().toDF("node", "component").join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    )
