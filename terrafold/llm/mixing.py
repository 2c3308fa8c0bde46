"""Mixing to target weights by soft membership.

A classifier trained on labelled rows gives each document a posterior over domains. Nonnegative rates (the
expected copies of a document) are fitted so that the expected tokens of each domain match their targets, by
projected gradient descent on the squared error; no rate goes below its least (1 where no document may be lost,
else 0). Each step is two distributed sums of a few numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import word_hashes

#: Production parameters: the domains are the labels' qualities, by their share of the mixed tokens.
TARGETS = {"low": 0.1, "high": 0.9}
_CLASS = np.zeros(256, np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 mark, 4 space, 5 line end, 6 beyond ASCII
_CLASS[:] = 3
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 4, 5


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, features) of texts: shares of kinds of bytes, and how long and how often repeated the words are."""
    out = np.zeros((len(texts), 12))
    tokens = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 500_000):
            size += len(texts[end])
            end += 1
        with np.errstate(over="ignore"):
            words, counts = word_hashes(texts[at:end])
        tokens[at:end] = counts
        first = 0
        for k in range(at, end):
            t, n = texts[k], int(counts[k - at])
            w = words[first : first + n]
            first += n
            if t:
                kinds = np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=7) / len(t)
                # how often a word is met again, by the largest of its kind too
                seen = np.sort(w)
                fresh = 1 + int((seen[1:] != seen[:-1]).sum()) if n else 0
                again = float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0
                out[k] = (*kinds, fresh / max(1, n), again, (len(t) - n) / max(1, n) / 10, np.log1p(n) / 10, 1.0)
            else:
                out[k, -1] = 1.0
        at = end
    return tokens, out


@dataclass
class Mix:
    """Classifier weights and the steps of the fit; a document's rate follows from its posterior alone."""

    names: list[str]
    coef: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)  # of each the step and the gradient, both by domain
    least: float = 0.0

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.center) / self.scale) @ self.coef.T
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30))) + 1e-9
        return p / p.sum(axis=1, keepdims=True)

    def rate(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for step, slope in self.steps:
            r = np.where(self.bound(p, r, slope), r, np.maximum(self.least, r - p @ step))
        return r

    def bound(self, p: np.ndarray, r: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Where a rate is the least and would go down."""
        return (r <= self.least) & (p @ slope >= 0)


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def classifier(docs: DataFrame, labels: DataFrame, domain: str, names: list[str], max_rows: int = 20_000) -> Mix:
    """One logistic fit for each domain, normalised, on at most ``max_rows`` labelled rows, those of least hashed id.

    ``domain`` is an SQL expression over ``labels`` for the domain's name. Without labelled rows the posterior is even."""
    chosen = labels.where("doc_id is not null").select("doc_id", F.expr(domain).alias("_domain")).where(F.col("_domain").isin(names))
    chosen = chosen.groupBy("doc_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = features(_raw(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x))], ["domain", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_domain", "text")
    rows = rows.mapInArrow(run, "domain string, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, 12)
    is_of = np.array(rows["domain"].to_pylist(), dtype=object)
    center, scale = np.zeros(12), np.ones(12)
    coef = np.zeros((len(names), 12))
    if len(x):
        center[:-1], scale[:-1] = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-6
        z = (x - center) / scale
        for k, name in enumerate(names):
            y = (is_of == name).astype(float)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ coef[k], -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(12), z.T @ (y - p) - coef[k])
                coef[k] += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
                if np.abs(step).max() < 1e-6:
                    break
    return Mix(names, coef, center, scale)


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "if(quality = 1, 'high', 'low')", total: float | None = None, rounds: int = 40, tolerance: float = 1e-6) -> Mix:
    """The mix for ``docs``: token totals of every row, steps until the largest relative miss is under ``tolerance``.

    ``total`` tokens are asked for, and rates are 0 or more. By default no rate is under 1, so documents are
    repeated and never lost: the total is the least for which rates of 1 + posterior . y with y >= 0 meet the
    targets, if that is at most the tokens divided by the least share. Else it is the least for which no domain
    need shrink, and a miss remains. All rates are 1 where all posteriors are alike."""
    names = sorted(targets)
    mix = classifier(docs, labels, domain, names)
    mix.least = 1.0 if total is None else 0.0

    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, x = features(_raw(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(list(mix.posterior(x)))], ["tokens", "p"])

    table = written(docs.select("text").mapInArrow(soft, "tokens long, p array<double>"), "posteriors")
    d = len(names)

    def summed(slope: np.ndarray | None) -> np.ndarray:
        """The tokens of each domain; with the gradient, the second moments of the documents whose rates are free."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = np.zeros(d if slope is None else d * d)
            for b in batches:
                t, p = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
                r = mix.rate(p)
                v += (r * t) @ p if slope is None else ((p * (t * ~mix.bound(p, r, slope))[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["k", "v"])

        rows = table.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r["v"] for r in rows]) if rows else np.zeros(d if slope is None else d * d)

    have = summed(None)
    if have.sum() <= 0:
        return mix
    share = np.array([targets[n] for n in names]) / sum(targets.values())
    if total is None:
        square = summed(np.full(d, -1.0)).reshape(d, d)  # all rates may go up
        if np.linalg.cond(square) >= 1e9:
            return mix
        each = np.linalg.solve(square, share)  # y = total * each - 1 meets the targets
        total = float((1 / each).max()) if (each > 0).all() else float("inf")
        if not total <= have.sum() / share[share > 0].min():
            total = float((have[share > 0] / share[share > 0]).max())
    want = share * total
    miss = float(np.linalg.norm(have - want))
    for _ in range(rounds):
        if np.abs(have - want).max() <= tolerance * want.sum():
            break
        slope = have - want
        square = summed(slope).reshape(d, d)
        # the gradient step, scaled so that it would be exact without the bound
        step = np.linalg.pinv(square, rcond=1e-9, hermitian=True) @ slope
        before = miss
        for _ in range(rounds):
            mix.steps.append(np.stack([step, slope]))
            have = summed(None)
            miss = float(np.linalg.norm(have - want))
            if miss < before:
                break
            mix.steps.pop()  # too far: half the step
            step = step / 2
        else:
            break
        if before - miss <= tolerance * before:
            break
    return mix


def _applied(docs: DataFrame, mix: Mix, columns: list[str], repeat: bool) -> DataFrame:
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    if not repeat:
        schema += ", tokens long, " + ", ".join(f"p_{n} double" for n in mix.names) + ", rate double, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(columns)
            tokens, x = features(_raw(b.column(n)))
            p = mix.posterior(x)
            rate = mix.rate(p)
            copies = np.floor(rate + b.column(n + 1).to_numpy()).astype(np.int64)
            if repeat:
                at = pa.array(np.repeat(np.arange(len(copies)), copies))
                yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in range(n)], columns)
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), pa.array(tokens), *(pa.array(p[:, k].copy()) for k in range(len(mix.names))), pa.array(rate), pa.array(copies)], [*columns, "tokens", *(f"p_{m}" for m in mix.names), "rate", "copies"])

    # a number in [0, 1) that stays with the document
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.select(*columns, F.col("text").alias("_text"), luck.alias("_luck")).mapInArrow(run, schema)


def mixture(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its tokens, domain posteriors, rate, and whole copies to take.

    Copies are the rate rounded down or up by a number that stays with the document, so their mean is the rate.
    A null text has no tokens and the posterior of an empty one. Rows are independent; repeated rows and rows
    without an id are rated each. An empty table gives an empty result."""
    return _applied(docs, fit(docs, labels, **how), ["doc_id"], False)


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as its copies; all columns stay."""
    return _applied(docs, fit(docs, labels, **how), docs.columns, True)
