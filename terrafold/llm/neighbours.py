"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

A stated set of queries meets all rows, block by block. In a tile of query block and row block, the product
of the int8 codes gives each inner product up to a bound; the pairs that may be among the nearest are
computed again from the original vectors in double precision. The tiles' short lists are merged by a heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def usable(vector: str) -> Column:
    """Not null, not zero, every component finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, block, ids binary, items binary): about ``rows`` vectors in each block, dealt by hashed id."""
    n = vectors.count()
    blocks = max(1, -(-n // rows))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        items = np.concatenate([np.zeros(0, np.float64), *(c.flatten().to_numpy() for c in t["v"].chunks)])
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": [t["vec_id"].to_numpy().tobytes()], "items": [items.tobytes()]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids binary, items binary")


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the norm of what the codes stand for, and the norm of the error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    meant = codes * scale[:, None]
    return codes, scale, np.linalg.norm(meant, axis=1), np.linalg.norm(x - meant, axis=1)


def tile(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores): the k nearest rows of the tile to each query, nearest first, ties to the smaller id."""
    (qc, qs, qn, qe), (xc, xs, xn, xe) = coded(q), coded(x)
    # products of int8 codes are whole numbers; float32 holds them exactly for up to 1,000 dimensions
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    near = (qc.astype(kind) @ xc.T.astype(kind)).astype(np.float64) * qs[:, None] * xs[None, :]
    # <q, x> - <q', x'> = <q - q', x> + <q', x - x'>, with |x| <= |x'| + |x - x'|
    bound = qe[:, None] * (xn + xe)[None, :] + qn[:, None] * xe[None, :] + 1e-9 * (1 + qn[:, None] * xn[None, :])
    own = qid[:, None] == xid[None, :]
    low = np.where(own, -np.inf, near - bound)
    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((near + bound >= least[:, None]) & ~own)
    score = np.zeros(len(i))
    for d in range(q.shape[1]):  # in the order of the components, as a plain sum would
        score += q[i, d] * x[j, d]
    order = np.lexsort((xid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.searchsorted(i, np.arange(len(q) + 1))
    for r in range(len(q)):
        a, b = starts[r], min(starts[r + 1], starts[r] + k)
        yield int(qid[r]), xid[j[a:b]], score[a:b]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, query_rows: int = 512, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``.

    Each query gets its ``k`` nearest other rows (all, if fewer) by largest inner product, ties to the smaller
    id. Every row is searched, so the result is exact. Rows without an id, and vectors that are null, empty,
    zero or hold a null or non-finite component take no part. Rows that repeat an id count once (the least
    vector). Vectors meet only others of their dimension. Other columns are ignored."""
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    good = written(good.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    rows = written(_packed(good, block_rows), "blocks")
    queries = _packed(good.where(F.col("vec_id") % every == 0), query_rows).toDF("dim", "query_block", "query_ids", "query_items")
    blocks = rows.select("dim", "block")
    pairs = queries.join(F.broadcast(blocks) if blocks.count() < 100_000 else blocks, "dim").join(rows, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qid, xid = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in ("query_ids", "ids"))
                q, x = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(n, -1) for c, n in (("query_items", len(qid)), ("items", len(xid))))
                out = list(tile(q, qid, x, xid, k))
                yield pa.RecordBatch.from_pydict(
                    {"query_id": [o[0] for o in out], "ids": [o[1].tolist() for o in out], "scores": [o[2].tolist() for o in out]},
                    schema=pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]),
                )

    lists = pairs.select("query_ids", "query_items", "ids", "items").mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    gathered = lists.groupBy("query_id").agg(F.collect_list(F.struct("scores", "ids")).alias("lists"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            out: list[tuple] = []
            for q, each in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best = heapq.merge(*([(-s, i) for s, i in zip(x["scores"], x["ids"], strict=True)] for x in each))
                out += [(q, r, i, -s) for r, (s, i) in enumerate(islice(best, k), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return gathered.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
