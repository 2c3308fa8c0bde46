"""Every query of the plans against its SQL on another engine, value by value."""

import os

import duckdb
import pytest

import terrafold.plans.polygons  # noqa: F401
import terrafold.plans.reports  # noqa: F401
import terrafold.plans.rules  # noqa: F401
import terrafold.plans.warps  # noqa: F401
from terrafold.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def test_each_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same(spark, other, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = other.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
