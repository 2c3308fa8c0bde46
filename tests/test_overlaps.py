"""Overlapping boxes: each pair once, and no exchange of pairs."""

import random

from terrafold.operators import spatial, tables


def frame(spark, n):
    r = random.Random(n)
    rows = []
    for k in range(n):
        x, y = r.randrange(-60, 200), r.randrange(0, 120)
        rows.append((k, float(x), float(y), float(x + r.randrange(0, 70)), float(y + r.randrange(0, 40))))
    return rows, spark.createDataFrame([*rows, (None, 0.0, 0.0, 500.0, 500.0), (n, None, 0.0, 5.0, 5.0)], "parcel_id long, minx double, miny double, maxx double, maxy double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_losses(spark):
    rows, df = frame(spark, 120)
    share = lambda p, q: max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
    want = {(p[0], q[0]): share(p, q) for p in rows for q in rows if p[0] < q[0] and share(p, q) > 0}
    got = spatial.overlaps(df, "parcel_id", 50.0, 0.0)
    assert got.columns == ["a", "b", "area"] and {(r.a, r.b): r.area for r in got.collect()} == want and got.count() == len(want)
    assert {(r.a, r.b) for r in spatial.overlaps(df, "parcel_id", 13.0, 100.0).collect()} == {k for k, v in want.items() if v >= 100}
    size = {p[0]: (p[3] - p[1]) * (p[4] - p[2]) for p in rows}
    lost: dict = {}
    for (a, b), area in want.items():
        lost.setdefault(b if size[a] >= size[b] else a, []).append(area)
    sized = spatial.overlap_losses(df, "parcel_id", 50.0)
    for losses in (sized, tables.kept_by_largest(df, got)):
        assert {r.parcel_id: (r.lost_m2, r.overlaps) for r in losses.collect()} == {k: (sum(v), len(v)) for k, v in lost.items()}


def test_exchanges(spark):
    """No pair is shuffled: parcels are dealt out once, and sums once more."""
    _, df = frame(spark, 50)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        exchanges = lambda df: tuple(plan(df).count(x) for x in ("- Exchange", "Join"))
        assert exchanges(spatial.overlaps(df, "parcel_id", 50.0, 0.0)) == (1, 0)
        assert exchanges(spatial.overlap_losses(df, "parcel_id", 50.0)) == (2, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_few_rows_at_a_time(spark):
    """A cell whose rows come in many batches."""
    rows, df = frame(spark, 300)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.a, r.b, r.area) for r in spatial.overlaps(df, "parcel_id", 500.0, 0.0).collect()}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = [(r.a, r.b, r.area) for r in spatial.overlaps(df, "parcel_id", 500.0, 0.0).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) and set(got) == want
