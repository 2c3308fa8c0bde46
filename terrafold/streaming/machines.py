"""Tasks and groups with rules, as state per key: legal transitions, quiet tasks, complete groups, live feeds, stages.

State lives in the store that Spark checkpoints, a row or a small map for each open key, and goes when a key is done.
A query that is started again from its checkpoint goes on where it was and repeats nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrafold.operators.tasks import FINAL

#: The states that may follow each state; a task begins as queued or running.
LEGAL = {None: ("queued", "running"), "queued": ("running", "cancelled"), "running": ("cancelling", *FINAL), "cancelling": FINAL, **dict.fromkeys(FINAL, ())}
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> None:
    """State of this kind needs the store on disk; a session that names one keeps it."""
    if spark.conf.get(STATE_STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TaskMachine(StatefulProcessor):
    """One task: (status, sequence, timer). Rows of a batch come in the order of time; a quiet task fails."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, sequence long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, n, timer = self.now.get() if self.now.exists() else (None, 0, None)
        latest = 0
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            n += 1
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            if r["type"] in LEGAL.get(status, ()):
                status = r["type"]
                error = None
            else:
                error = f"{status or 'nothing'} -> {r['type']}"
            yield Row(task_id=key[0], event_id=r["event_id"], sequence=n, status=status, error=error)
        if self.quiet_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = None if status in FINAL else max(latest, timerValues.getCurrentWatermarkInMs()) + self.quiet_ms
            if timer:
                self.handle.registerTimer(timer)
        self.now.update((status, n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.now.exists():
            status, n, _ = self.now.get()
            if status not in FINAL:
                self.now.update(("failed", n + 1, None))
                yield Row(task_id=key[0], event_id=None, sequence=n + 1, status="failed", error=f"quiet while {status}")

    def close(self) -> None:
        pass


def task_states(events: DataFrame, quiet: timedelta | None = None, late: str = "1 minute") -> DataFrame:
    """(task_id, event_id, sequence, status, error) for a stream of events (task_id, event_id, ts, type).

    An event that is no legal next state leaves the status and tells what was tried as ``error``; after a final state
    every event is such. With ``quiet``, a task without an event for that long fails once the
    watermark, ``late`` behind the latest event, has passed; without, tasks may be quiet for ever."""
    with_state_store(events.sparkSession)
    ms = int(quiet.total_seconds() * 1000) if quiet else 0
    rows = events.select("task_id", "event_id", "ts", "type")
    rows = rows.withWatermark("ts", late) if quiet else rows
    schema = "task_id long, event_id long, sequence long, status string, error string"
    return rows.groupBy("task_id").transformWithState(TaskMachine(ms), schema, "Append", "EventTime" if quiet else "None")


class GroupGate(StatefulProcessor):
    """One group: the items that have come, until all have; then only that it was passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "ok boolean")
        self.done = handle.getValueState("done", "passed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed = self.done.exists()
        expected = None
        for r in rows:
            expected = r["expected"]
            if not passed and not (self.items.containsKey((r["item"],)) and self.items.getValue((r["item"],))[0]):
                self.items.updateValue((r["item"],), (bool(r["ok"]),))
        if passed or expected is None:
            return
        held = list(self.items.iterator())
        good = sum(1 for _, v in held if v[0])
        if good >= expected:
            self.items.clear()
            self.done.update((True,))
            yield Row(group_id=key[0], items=sorted(k[0] for k, v in held if v[0]))

    def close(self) -> None:
        pass


def complete_groups(items: DataFrame) -> DataFrame:
    """(group_id, items): each group once, when as many different items as ``expected`` have come with ``ok``.

    ``items``: a stream of (group_id, expected, item, ok). A failed item counts when it comes again with ok; repeats
    count once, and what comes after the group was passed on is ignored."""
    with_state_store(items.sparkSession)
    rows = items.select("group_id", "expected", "item", "ok")
    return rows.groupBy("group_id").transformWithState(GroupGate(), "group_id string, items array<string>", "Append", "None")


class Feed(StatefulProcessor):
    """One task's cursor: it begins at the last event of the history and lets only later ones through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "sequence long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.cursor.update((initialState["sequence"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = self.cursor.get()[0] if self.cursor.exists() else 0
        for r in sorted(rows, key=lambda r: r["sequence"]):
            if r["sequence"] > at:
                at = r["sequence"]
                yield Row(task_id=key[0], sequence=at, event=r["event"])
        self.cursor.update((at,))

    def close(self) -> None:
        pass


def live(history: DataFrame, events: DataFrame) -> DataFrame:
    """(task_id, sequence, event) of the stream past each task's history, each once: what a subscriber gets after the replay."""
    with_state_store(events.sparkSession)
    cursors = history.groupBy("task_id").agg(F.max("sequence").alias("sequence"))
    schema = "task_id long, sequence long, event string"
    return events.select("task_id", "sequence", "event").groupBy("task_id").transformWithState(Feed(), schema, "Append", "None", cursors.groupBy("task_id"))


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def subscribed(history: DataFrame, events: DataFrame, folder: str):
    """Starts a feed below ``folder``: the history once, then what is live; started again, it goes on.

    Read it with ``feed``. The history that the first start saw stays the one that cursors begin at."""
    spark = events.sparkSession
    if not _there(spark, f"{folder}/history"):
        history.select("task_id", "sequence", "event").write.mode("overwrite").parquet(f"{folder}/history")
    replay = spark.read.parquet(f"{folder}/history")
    writer = live(replay, events).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/live")
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, sequence, event) of a feed so far: history, then live."""
    old = spark.read.parquet(f"{folder}/history")
    return old.unionByName(spark.read.schema(old.schema).parquet(f"{folder}/live")) if _there(spark, f"{folder}/live") else old


def staged(groups: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str):
    """Starts a stream in which each batch of groups goes through all stages at once, each written before the next reads it.

    ``folder``/stage holds a stage's rows by ``batch``. A batch that is tried again, after a failure or a restart, writes
    over its own rows only, so nothing is done twice in the result."""

    def run(batch: DataFrame, number: int) -> None:
        for name, stage in stages:
            path = f"{folder}/{name}/batch={number}"
            stage(batch).write.mode("overwrite").parquet(path)
            batch = batch.sparkSession.read.parquet(path)

    return groups.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
