"""Embedding whitening by LOBPCG: the leading eigenvectors of the covariance from distributed block products.

The covariance is never formed. Each round multiplies it with a small orthonormal block (iterate, residuals and
previous directions), as a sum over centred rows on the executors; Rayleigh-Ritz on that block gives the next
iterate. Rounds go on until the residuals are so small that the vectors are right to double precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Rows multiplied at once on an executor.
AT_ONCE = 4096
#: Directions iterated beyond the wanted ones, so that near eigenvalues do not slow the wanted ones down.
GUARD = 12
#: A residual under so many units of rounding of the largest eigenvalue cannot be made smaller.
FLOOR = 32
ROUNDS = 300


@dataclass
class Fit:
    """What is known of the vectors of one dimension: n distinct ones, their sums, and the leading components (rows of ``axes``)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    rounds: int


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>, dim): x = floor(256 c); vectors that are null or hold a null or non-finite component are left out.

    Components beyond a long are held at its ends."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(256 * c)).alias("x"), F.size("v").alias("dim"))


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(dim, rows) of the vectors in the first column, by dimension (second column)."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for d in np.unique(dims):
            mine = b.column(0).filter(pa.array(dims == d))
            for at in range(0, len(mine), size):
                part = mine.slice(at, size)
                yield int(d), part.flatten().to_numpy().reshape(len(part), d)


def _summed(rows: DataFrame, function) -> dict[int, np.ndarray]:
    """The sum over all rows of ``function(dim, matrix)``, an array of the same shape for all matrices of a dimension.

    Each task adds up its own rows; the sums of tasks are added up by cell, so the driver gets one array a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, x in _matrices(batches, AT_ONCE):
            y = function(d, x)
            sums[d] = sums[d] + y if d in sums else y
        for d, y in sums.items():
            flat = y.ravel()
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(flat), d, np.int32), "cell": np.arange(len(flat), dtype=np.int32), "value": flat})

    cells = rows.select("x", "dim").mapInArrow(run, "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
    got = cells.toArrow().to_pandas().sort_values(["dim", "cell"])
    return {int(d): g["value"].to_numpy() for d, g in got.groupby("dim")}


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks; earlier blocks are kept, directions already spanned are dropped."""
    out = np.zeros((len(blocks[0]), 0))
    for b in blocks:
        for v in b.T:
            size = np.linalg.norm(v)
            if not size:
                continue
            v = v / size
            for _ in range(3):  # again, as one pass leaves what rounding left
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-8 and out.shape[1] < len(v):
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def fit(rows: DataFrame, components: int = 4) -> dict[int, Fit]:
    """The leading components of each dimension's vectors. ``rows`` (x, dim): each vector once.

    The driver holds blocks of (dimension x a few dozen), nothing that grows with the rows."""
    cells = rows.select("dim", F.posexplode("x").alias("cell", "c")).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    counts: dict[int, tuple[int, list[int]]] = {}
    for r in cells.orderBy("dim", "cell").collect():  # a row for each component
        n, s = counts.setdefault(r["dim"], (r["n"], []))
        s.append(int(r["s"]))
    mean = {d: np.array([v / n for v in s]) for d, (n, s) in counts.items()}
    traces = _summed(rows.where("dim > 0"), lambda d, x: np.array([((x - mean[d]) ** 2).sum()]))
    traces = {d: float(t[0]) / counts[d][0] for d, t in traces.items()}
    out = {}
    state = {}
    for d, (n, s) in counts.items():
        m = min(d, components + GUARD)
        start = _basis(np.random.default_rng(d).standard_normal((d, m)))
        state[d] = (start, None)
        if traces[d] == 0:
            k = min(components, d)
            out[d] = Fit(n, s, mean[d], np.eye(d)[:k], np.zeros(k), 0.0, np.zeros(k), 0)
    for done in range(1, ROUNDS + 1):
        open_ = {d: v for d, v in state.items() if d not in out}
        if not open_:
            return out
        blocks = {d: _basis(v[0], *([v[1]] if v[1] is not None else [])) for d, v in open_.items()}
        some = rows if len(open_) == len(counts) else rows.where(F.col("dim").isin(sorted(open_)))

        def product(d: int, x: np.ndarray, blocks=blocks) -> np.ndarray:
            c = x - mean[d]
            return c.T @ (c @ blocks[d])

        for d, flat in _summed(some, product).items():
            q, n = blocks[d], counts[d][0]
            vq = flat.reshape(q.shape) / n
            small = q.T @ vq
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)[: min(d, components + GUARD)]
            values, turn = values[order], turn[:, order]
            x, vx = q @ turn, vq @ turn
            residual = vx - x * values
            size = np.linalg.norm(residual, axis=0)
            k = min(components, d)
            exact = q.shape[1] == d  # the block spans everything: nothing is left to be found
            if size[:k].max() <= FLOOR * np.finfo(float).eps * max(values[0], traces[d] / d) or (exact and done > 1):
                out[d] = Fit(counts[d][0], counts[d][1], mean[d], np.ascontiguousarray(x[:, :k].T), np.maximum(values[:k], 0), traces[d], size[:k], done)
                continue
            # the previous direction: what the new iterate took from outside the old one
            old = state[d][0]
            state[d] = (x, np.column_stack([residual, x - old @ (old.T @ x)]))
    raise RuntimeError(f"no convergence in {ROUNDS} rounds")


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over components of (n x - S)^2, exact; null where it does not fit a long."""
    s = np.array(sums, object)
    most = max(int(np.abs(x, dtype=object).max()) if x.size else 0, 1)
    worst = (n * most + max((abs(v) for v in sums), default=0)) ** 2 * max(x.shape[1], 1)
    if worst < 1 << 63:
        return ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [int(v) for v in ((n * x.astype(object) - s) ** 2).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) for each usable row of ``vectors``.

    Rows whose ``embedding`` is null or holds a null or non-finite component are dropped. Vectors of another dimension
    are fitted and whitened apart; an empty vector has no components, so no rows. The fit counts equal vectors once;
    repeated rows and rows without a vec_id have rows of their own. A vector of fewer dimensions than ``components`` has
    as many components as dimensions. A component without variance (rank too low, one distinct vector) has whitened
    null, and takes no part in identity_error, which is null if there is no other; explained is null if nothing varies.
    ``residual`` is the norm of V u - e u over the largest e. Other columns are ignored; an empty table gives one."""
    small_batches(vectors.sparkSession, AT_ONCE)
    rows = written(scaled(vectors), "vectors")
    once = written(rows.where("dim > 0").select("x", "dim").distinct(), "fit-list")
    fits = fit(once, components)
    alive = {d: f.values > 1e-12 * max(f.trace, 1e-300) for d, f in fits.items()}
    axes = {d: (f.axes / np.sqrt(np.where(alive[d], f.values, np.inf))[:, None]).T for d, f in fits.items()}

    def white(d: int, x: np.ndarray) -> np.ndarray:
        return (x - fits[d].mean) @ axes[d]

    centre = {d: s / fits[d].n for d, s in _summed(once, lambda d, x: white(d, x).sum(axis=0)).items()}

    def spread(d: int, x: np.ndarray) -> np.ndarray:
        w = white(d, x) - centre[d]
        return w.T @ w

    errors = {}
    for d, flat in _summed(once, spread).items():
        k = len(fits[d].values)
        off = np.abs(flat.reshape(k, k) / fits[d].n - np.eye(k))[np.ix_(alive[d], alive[d])]
        errors[d] = float(off.max()) if off.size else None
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("residual", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                mine = b.filter(pa.array(dims == d))
                d, f = int(d), fits[int(d)]
                x = mine.column(1).flatten().to_numpy().reshape(mine.num_rows, d)
                k = len(f.values)
                w = np.where(alive[d], white(d, x), 0)
                share = [float(v / f.trace) if f.trace else None for v in f.values]
                yield pa.RecordBatch.from_arrays(
                    [
                        mine.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, f.n)),
                        pa.array(_deviation(x, f.n, f.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(w.ravel(), mask=~np.tile(alive[d], len(x))),
                        pa.array(share * len(x), pa.float64()),
                        pa.array([errors[d]] * (len(x) * k), pa.float64()),
                        pa.array((f.residuals / max(f.values[0], 1e-300)).tolist() * len(x)),
                    ],
                    schema=schema,
                )

    return rows.where("dim > 0").select("vec_id", "x", "dim").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
