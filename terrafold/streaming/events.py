"""Task logs as streams: running numbers, last states and ready groups, each with bounded state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrafold.operators.tasks import FINAL


def numbered(events: DataFrame) -> DataFrame:
    """(task_id, event_id, type, sequence): each task's events numbered as they come, in the order of time within a batch.

    The state of a task is one number; it is dropped once the task has reached a final type."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = pd.DataFrame({"task_id": key[0], "event_id": rows["event_id"], "type": rows["type"], "sequence": range(n + 1, n + 1 + len(rows))})
        if rows["type"].isin(FINAL).any():
            state.remove()
        else:
            state.update((n + len(rows),))
        yield out

    keyed = events.select("task_id", "event_id", "ts", "type").groupBy("task_id")
    return keyed.applyInPandasWithState(run, "task_id long, event_id long, type string, sequence long", "n long", "append", GroupStateTimeout.NoTimeout)


def states(events: DataFrame) -> DataFrame:
    """(task_id, type, events): the type last seen of each task; for the update and complete modes."""
    return events.groupBy("task_id").agg(F.max_by("type", F.struct("ts", "event_id")).alias("type"), F.count("*").alias("events"))


def ready_paths(lines: DataFrame, pattern: str = r"READY\s+(\S+)", late: str = "1 hour") -> DataFrame:
    """(ts, path) of marker lines, each path once within the watermark; state older than that is dropped."""
    found = lines.withColumn("path", F.regexp_extract("line", pattern, 1)).where("path != ''")
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"]).select("ts", "path")


def per_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Number and mean value of events by window and type (an extension: the stream has no such query of its own)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "type")
    return w.agg(F.count("*").alias("events"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "type", "events", "mean")
