"""Ranges of keys against plain loops, with one key and one task that most rows share."""

from terrafold.operators import ranges, tasks


def test_numbered(spark):
    keys = [None, None] + [7] * 500 + list(range(300))
    out = ranges.numbered(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long"), "k", "no").collect()
    assert sorted(r.no for r in out) == list(range(len(keys)))
    assert sorted(r.i for r in out) == list(range(len(keys)))
    ordered = [r.k for r in sorted(out, key=lambda r: r.no)]
    assert ordered == [None, None] + sorted(k for k in keys if k is not None)


def test_numbered_empty(spark):
    assert ranges.numbered(spark.createDataFrame([], "k long"), "k", "no").columns == ["k", "no"]
    assert ranges.numbered(spark.createDataFrame([], "k long"), "k", "no").count() == 0


def test_many_keys_are_split(spark):
    rows = ranges.ranged(spark.range(4000).selectExpr("1 AS k"), "k")
    assert rows.groupBy("range").count().agg({"count": "max"}).first()[0] < 2500


def test_smoothed(spark):
    speeds = {"hot": [float(i * 37 % 101) for i in range(700)], "one": [5.0], "gap": [1.0, None, 2.0], "two": [4.0, 8.0]}
    rows = [(t, i, v) for t, vs in speeds.items() for i, v in enumerate(vs)]
    got = {r.task_id: r.speed for r in tasks.smoothed(spark.createDataFrame(rows[::-1], "task_id string, sequence long, speed double")).collect()}
    assert got.pop("gap") is None
    for t, speed in got.items():
        want = speeds[t][0]
        for v in speeds[t][1:]:
            want = want * (1 - 0.35) + v * 0.35
        assert abs(speed - want) < 2e-6
    assert len(got) == 3
