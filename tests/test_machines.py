"""Stateful streams over small files, stopped and started again from their checkpoints."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrafold.streaming import machines as M

T0 = dt.datetime(2024, 1, 1)
EVENTS = "task_id long, event_id long, ts timestamp, type string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, folder):
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect()


def plain(events):
    """The machine, one event after another."""
    status, out = None, []
    for n, (i, kind) in enumerate(events, 1):
        legal = kind in M.LEGAL[status]
        out.append((i, n, kind if legal else status, None if legal else f"{status or 'nothing'} -> {kind}"))
        status = kind if legal else status
    return out


def test_task_states(spark, tmp_path):
    """Each batch of files, with a restart between the batches, against the plain machine."""
    r = random.Random(9)
    kinds = ["queued", "running", "cancelling", "completed", "failed", "cancelled", "progress"]
    events = [(r.randrange(6), k, T0 + dt.timedelta(seconds=k), r.choice(kinds[: 2 + k % 6])) for k in range(90)]
    folder = str(tmp_path / "in")
    for at in range(0, 90, 30):
        put(spark, folder, r.sample(events[at : at + 30], 30), EVENTS)
        got = drain(M.task_states(source(spark, folder, EVENTS)), str(tmp_path))
        assert len(got) == at + 30
    want = {t: plain([(i, kind) for task, i, _, kind in events if task == t]) for t in range(6)}
    have: dict = {}
    for g in sorted(got, key=lambda g: g.sequence):
        have.setdefault(g.task_id, []).append((g.event_id, g.sequence, g.status, g.error))
    assert have == {t: w for t, w in want.items() if w}
    assert {"queued -> completed", "nothing -> completed"} & {g.error for g in got} or any(g.error for g in got)


def test_quiet_tasks_fail(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    put(spark, folder, [(1, 1, at(0), "running"), (2, 2, at(0), "running"), (3, 3, at(0), "running"), (3, 4, at(1), "completed")], EVENTS)
    put(spark, folder, [(2, 5, at(50), "cancelling")], EVENTS)
    put(spark, folder, [(4, 6, at(90), "queued")], EVENTS)
    put(spark, folder, [(4, 7, at(91), "running")], EVENTS)
    got = drain(M.task_states(source(spark, folder, EVENTS), quiet=dt.timedelta(hours=1)), str(tmp_path))
    assert [(g.task_id, g.sequence, g.status, g.error) for g in got if g.event_id is None] == [(1, 2, "failed", "quiet while running")]
    put(spark, folder, [(1, 8, at(92), "completed")], EVENTS)
    got = drain(M.task_states(source(spark, folder, EVENTS), quiet=dt.timedelta(hours=1)), str(tmp_path))
    assert [(g.sequence, g.status, g.error) for g in got if g.event_id == 8] == [(3, "failed", "failed -> completed")]


def test_complete_groups(spark, tmp_path):
    schema = "group_id string, expected long, item string, ok boolean"
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", 3, "x", True), ("a", 3, "x", True), ("b", 2, "p", True), ("c", 1, "s", False)], schema)
    put(spark, folder, [("a", 3, "y", False), ("a", 3, "z", True), ("b", 2, "q", True), ("b", 2, "p", False)], schema)
    got = drain(M.complete_groups(source(spark, folder, schema)), str(tmp_path))
    assert [(g.group_id, g["items"]) for g in got] == [("b", ["p", "q"])]
    put(spark, folder, [("a", 3, "y", True), ("b", 2, "p", True), ("b", 2, "r", True), ("c", 1, "s", True)], schema)
    got = drain(M.complete_groups(source(spark, folder, schema)), str(tmp_path))
    assert sorted((g.group_id, g["items"]) for g in got) == [("a", ["x", "y", "z"]), ("b", ["p", "q"]), ("c", ["s"])]


def test_feed(spark, tmp_path):
    """A subscriber sees the history, then only later events, each once, over restarts."""
    schema = "task_id long, sequence long, event string"
    every = [(t, n, f"{t}.{n}") for t in (1, 2, 3) for n in range(1, 9)]
    history = spark.createDataFrame([e for e in every if e[0] < 3 and e[1] <= 4], schema)
    folder, out = str(tmp_path / "in"), str(tmp_path / "feed")
    put(spark, folder, [e for e in every if 3 <= e[1] <= 5 or (e[0] == 3 and e[1] < 3)], schema)
    for _ in range(2):
        q = M.subscribed(history, source(spark, folder, schema), out)
        q.awaitTermination(120)
        assert sorted(tuple(r) for r in M.feed(spark, out).collect()) == [e for e in every if e[1] <= 5]
    put(spark, folder, [e for e in every if e[1] >= 5], schema)
    M.subscribed(history, source(spark, folder, schema), out).awaitTermination(120)
    assert sorted(tuple(r) for r in M.feed(spark, out).collect()) == every


def test_staged(spark, tmp_path):
    """A failing stage stops its batch; started again, each group passes every stage once."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "work")
    for k in range(3):
        put(spark, folder, [(k * 10 + i,) for i in range(4)], "id long")
    broken = [True]

    def clip(df):
        if broken[0] and df.where("id >= 10").count():
            raise RuntimeError("no space")
        return df.withColumn("clipped", F.col("merged") + 1)

    stages = [("merge", lambda df: df.withColumn("merged", F.col("id") * 2)), ("clip", clip), ("report", lambda df: df.select("id", "clipped"))]
    with pytest.raises(Exception, match="no space"):
        M.staged(source(spark, folder, "id long"), stages, out).awaitTermination(120)
    broken[0] = False
    M.staged(source(spark, folder, "id long"), stages, out).awaitTermination(120)
    for name, _ in stages:
        assert sorted(r.id for r in spark.read.parquet(f"{out}/{name}").collect()) == sorted(k * 10 + i for k in range(3) for i in range(4))
    assert all(r.clipped == 2 * r.id + 1 for r in spark.read.parquet(f"{out}/report").collect())
