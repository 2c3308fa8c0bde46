"""Streams over small files: numbers go on over batches, repeats are dropped, states are the last."""

import datetime as dt

from terrafold.streaming import events as E

SCHEMA = "task_id long, event_id long, ts timestamp, type string, value double, line string"


def batch(spark, folder, rows):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(a, b, t + dt.timedelta(minutes=m), k, 1.0, line) for a, b, m, k, line in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(df, spark, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch(spark, folder, [(1, 1, 0, "running", "READY /a"), (1, 2, 1, "progress", "READY /a"), (2, 3, 2, "running", "no")])
    batch(spark, folder, [(1, 4, 3, "completed", "READY /b"), (2, 5, 4, "failed", "READY /a")])
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.task_id, r.event_id): r.sequence for r in drain(E.numbered(source()), spark, "append", "numbered", tmp_path)}
    assert sorted(n for (t, _), n in got.items() if t == 1) == [1, 2, 3] and sorted(n for (t, _), n in got.items() if t == 2) == [1, 2]
    got = {r.task_id: (r.type, r.events) for r in drain(E.states(source()), spark, "complete", "states", tmp_path)}
    assert got == {1: ("completed", 3), 2: ("failed", 2)}
    assert sorted(r.path for r in drain(E.ready_paths(source()), spark, "append", "ready", tmp_path)) == ["/a", "/b"]
