"""Removal of every byte in a 200-byte string that also starts anywhere else, over whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slots, partitions, slot_bits, slot_filter, written
from .shingles import mix
from .suffixes import SIDE, WIDTH, anchored, repeated_windows, stretches

GROUP = 400_000  # bytes of distinct pieces in one suffix array
HOT = 4096  # pieces of one anchor in a bucket, about
AT_ONCE = 1_000_000


def _runs(b: pa.RecordBatch) -> Iterator[tuple]:
    """(document, its bytes, place of the bytes in the document, hashes, left keys, right keys, anchors, first and last windows), text by text; texts are hashed many at a time."""
    docs, texts = b.column(0).to_pylist(), b.column(1)
    held: list[tuple[int, bytes, int]] = []  # document, bytes, place of the bytes in the document

    def flush() -> Iterator:
        data = np.frombuffer(b"".join(t for _, t, _ in held), np.uint8)
        ends = np.cumsum([len(t) for _, t, _ in held])
        with np.errstate(over="ignore"):
            h, left, right, p, s, e = anchored(data, ends)
        cut = np.searchsorted(s, np.concatenate([[0], ends]))
        for k, (d, t, base) in enumerate(held):
            x, begin = slice(cut[k], cut[k + 1]), int(ends[k]) - len(t)
            if cut[k] < cut[k + 1]:
                yield d, t, base, h[x], left[x], right[x], p[x] - begin, s[x] - begin, e[x] - begin
        held.clear()

    size = 0
    for d, t in zip(docs, texts, strict=True):
        raw = memoryview(t.as_buffer()) if t.is_valid else b""
        for at in range(0, max(1, len(raw) - WIDTH + 1), AT_ONCE):
            part = bytes(raw[at : at + AT_ONCE + WIDTH - 1])
            held.append((d, part, at))
            size += len(part)
            if size >= AT_ONCE:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _keys(docs: DataFrame) -> DataFrame:
    """(key, n) of the left and right keys that are met more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, _, _, left, right, p, s, e in _runs(b):
                found += [left[s <= p - SIDE], right[e > p - SIDE]]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    return docs.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _mixed(keys: DataFrame) -> DataFrame:
    """The keys with their bits mixed, as the high ones alone tell anchors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array(mix(b.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["key"])

    return keys.mapInArrow(run, "key long")


def _pieces(docs: DataFrame, wanted: np.ndarray, high: int, hot: np.ndarray, buckets: np.ndarray) -> DataFrame:
    """(key, salt, salts, doc, base, anchor, piece): the bytes around each anchor that may be repeated, at ``base`` in the document.

    Of a run's windows only those go on whose key may be repeated (``wanted``).
    Anchors of very many pieces (in slot ``hot[k]``) are dealt over ``buckets[k]`` buckets. Of a piece that a task
    meets again and again, as in periodic text, the first two go on; of the others all is known to be repeated,
    so only their places do (with no piece, and their length as the anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[bytes, int] = {}
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for d, t, base, h, left, right, p, s, e in _runs(b):
                on_left = (s <= p - SIDE) & in_slots(wanted, mix(left), high)
                on_right = (e > p - SIDE) & in_slots(wanted, mix(right), high)
                s, e = np.where(on_left, s, np.maximum(s, p - SIDE + 1)), np.where(on_right, e, np.minimum(e, p - SIDE))
                begin = end = -1  # of the stretch known to be repeated
                slot = (h >> np.uint64(40)).astype(np.int64)
                at = np.minimum(np.searchsorted(hot, slot), max(0, len(hot) - 1))
                salts = np.where(hot[at] == slot, buckets[at], 1) if len(hot) else np.ones(len(slot), np.int64)
                deal = mix(np.full(len(h), d, np.int64).view(np.uint64) + s.astype(np.uint64)) % salts.astype(np.uint64)
                for k in np.flatnonzero(on_left | on_right).tolist():
                    first, last = int(s[k]), int(e[k]) + WIDTH
                    piece = t[first:last]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    n = times[digest] = times.get(digest, 0) + 1
                    if n <= 2:
                        rows.append((int(h[k].view(np.int64)), int(deal[k]), int(salts[k]), d, base + first, int(p[k]) - first, piece))
                        size += last - first
                    elif first <= end:
                        end = last
                    else:
                        if end > 0:
                            rows.append((d, -1, 1, d, base + begin, end - begin, None))
                        begin, end = first, last
                if end > 0:
                    rows.append((d, -1, 1, d, base + begin, end - begin, None))
                if len(times) > 500_000:
                    times.clear()
                if size > 8_000_000:
                    yield _table(rows)
                    rows, size = [], 0
            if rows:
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "salt", "salts", "doc", "base", "anchor", "piece"])

    return docs.mapInArrow(run, "key long, salt int, salts int, doc long, base long, anchor int, piece binary")


def _covered(pieces: DataFrame) -> DataFrame:
    """(doc, start, end, digest): stretches that are repeated; and, of anchors dealt over several buckets, the
    digests of windows that their bucket leaves open (with the window) or knows as repeated (without a document)."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        distinct: dict[tuple[bytes, int], list[tuple[int, int, bool]]] = {}
        for doc, base, anchor, piece, dealt in rows:
            distinct.setdefault((piece, anchor), []).append((doc, base, dealt))
        for ((piece, _), owners), twice in zip(distinct.items(), repeated_windows(list(distinct)), strict=True):
            if len(owners) > 1:
                twice[:] = True
            runs = stretches(np.flatnonzero(twice))
            for doc, base, _ in owners:
                for a, e in runs:
                    yield doc, base + a, base + e, None
            if any(o[2] for o in owners):
                doc, base, _ = owners[0]
                for k in range(len(twice)):
                    digest = hashlib.blake2b(piece[k : k + WIDTH], digest_size=16).digest()
                    yield (None, None, None, digest) if twice[k] else (doc, base + k, base + k + WIDTH, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = list(group(rows))
            if found:
                yield made(found)

        known: list[tuple] = []
        held: list[tuple] = []  # pieces of whole buckets
        mine: list[tuple] = []  # of the bucket being read
        size, key = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[6] is None:
                    known.append((r[3], r[4], r[4] + r[5], None))
                    if len(known) > 100_000:
                        yield made(known)
                        known = []
                    continue
                if r[:2] != key:
                    if len(mine) > 1 or (mine and mine[0][4]):  # a piece alone matches nothing, unless its anchor has other buckets
                        held += mine
                        if size > GROUP:
                            yield from out(held)
                            held, size = [], 0
                    mine, key = [], r[:2]
                mine.append((r[3], r[4], r[5], r[6], r[2] > 1))
                size += len(r[6])
        if len(mine) > 1 or (mine and mine[0][4]):
            held += mine
        if held:
            yield from out(held)
        if known:
            yield made(known)

    dealt = pieces.repartition(partitions(pieces.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(run, "doc long, start long, end long, digest binary")


def repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary].

    Each byte that a 200-byte string covers which also starts anywhere else, in this row or another, is
    removed; strings are judged on the input. A null text is empty; a text under 200 bytes keeps all. Rows
    that repeat (with or without an id) are documents of their own, and so remove each other. Other columns
    are ignored; an empty table gives an empty result."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    texts = keyed.select("doc", "raw")
    twice = written(_keys(texts), "anchors")
    high = slot_bits(twice.count())
    wanted = slot_filter(_mixed(twice.select("key")), high)  # keeps most windows that stand alone from being shuffled
    slot = F.shiftrightunsigned("key", 40).cast("int").alias("slot")
    hot = twice.groupBy(slot).agg(F.sum("n").alias("n")).where(F.col("n") > 4 * HOT).select("slot", F.ceil(F.col("n") / (2 * HOT)).alias("salts"))
    hot = hot.orderBy("slot").toArrow()  # at most 2^24 rows
    pieces = _pieces(texts, wanted, high, hot["slot"].to_numpy().astype(np.int64), hot["salts"].to_numpy().astype(np.int64))
    found = written(_covered(pieces), "covered")
    open_ = found.where("digest is not null")
    shared = open_.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    late = open_.where("doc is not null").join(shared, "digest", "left_semi").select("doc", "start", "end")
    spans = found.where("digest is null").select("doc", "start", "end").union(late)
    spans = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, raw, each in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw, kept, removed, n, at = raw.as_py(), [], 0, 0, 0
                for s in each.as_py() or []:
                    a, e = max(s["start"], at), s["end"]
                    if e > at:
                        n += not n or a > at
                        if a > at:
                            kept.append(raw[at:a])
                        removed += e - a
                        at = e
                kept.append(raw[at:])
                kept = b"".join(kept)
                rows.append((doc_id.as_py(), len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", kept binary" if with_text else ""
    return keyed.join(spans, "doc", "left").select("doc_id", "raw", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
