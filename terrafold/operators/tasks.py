"""Task logs: ordered events, states and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import numbered, ranged

#: States that a task doesn't leave.
FINAL = ("completed", "failed", "cancelled")


def sequenced(events: DataFrame) -> DataFrame:
    """Events numbered within their task, by time and id."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("task_id").orderBy("ts", "event_id")))


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events of each task past a cursor."""
    return events.where(F.col("sequence") > after)


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each task."""
    w = Window.partitionBy("task_id").orderBy(F.desc("sequence"))
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each task; an aggregate, so that it needs no sort."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("type", "ts"), "sequence").alias("e"), F.max("sequence").alias("last_sequence")).select("task_id", "e.type", "e.ts", "last_sequence")


def restarted(tasks: DataFrame) -> DataFrame:
    """After a restart, unfinished tasks have failed."""
    return tasks.withColumn("status", F.when(F.col("status").isin(*FINAL), F.col("status")).otherwise("failed"))


def evicted(tasks: DataFrame, keep: int) -> DataFrame:
    """All unfinished tasks, and the newest others up to ``keep`` tasks together."""
    active = ~F.col("status").isin(*FINAL)
    done = tasks.where(~active).orderBy(F.desc("created_at"), F.desc("task_id"))
    room = max(0, keep - tasks.where(active).count())
    return tasks.where(active).unionByName(done.limit(room))


def smoothed(samples: DataFrame, share: float = 0.35) -> DataFrame:
    """Exponential smoothing of speeds by task, in the order of sequence; the first is the seed, and a null makes the task's speed null.

    Each range of samples gives one weighted sum for a task, so that a task of any length is shared among the ranges."""
    keep = 1 - share
    rows = ranged(samples.select("task_id", "sequence", "speed"), "task_id", "sequence", "speed")
    later = F.row_number().over(Window.partitionBy("range", "task_id").orderBy(F.desc("sequence"), F.desc("speed"))) - 1
    rows = rows.withColumn("later", later)
    sums = rows.groupBy("task_id", "range").agg(
        F.count("*").alias("n"),
        F.count("speed").alias("known"),
        F.sum(F.col("speed") * share * F.pow(F.lit(keep), "later")).alias("sum"),
        F.max_by("speed", "later").alias("seed"),
    )
    after = F.coalesce(F.sum("n").over(Window.partitionBy("task_id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("after", after)  # at most a row for each range
    seed = F.max_by(F.col("seed") * F.pow(F.lit(keep), F.col("after") + F.col("n")), F.col("after"))
    speed = F.sum(F.col("sum") * F.pow(F.lit(keep), "after")) + seed
    return sums.groupBy("task_id").agg(F.when(F.sum("known") == F.sum("n"), F.round(speed, 6)).alias("speed"))


def progress_marks(progress: DataFrame, step: int = 5) -> DataFrame:
    """Only the rows at which a task enters another bucket of ``step`` percent."""
    w = Window.partitionBy("task_id").orderBy("sequence")
    bucket = F.floor(F.col("percent") / step) * step
    out = progress.withColumn("bucket", bucket).withColumn("_b", F.lag("bucket").over(w))
    return out.where("_b is null or _b != bucket").drop("_b")


def round_robin(rows: DataFrame, order: str, workers: int, per_client: int, clients: int) -> DataFrame:
    """Slot and client of each row by its number."""
    return numbered(rows, order, "slot").withColumn("slot", F.pmod("slot", F.lit(workers)).cast("int")).withColumn("client", F.least(F.floor(F.col("slot") / per_client), F.lit(clients - 1)).cast("int"))
