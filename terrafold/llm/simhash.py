"""SimHash near-duplicates: fingerprints split into blocks, joined on equal blocks, verified by Hamming distance.

Fingerprints that differ in at most 3 bits have one of 4 blocks in common. A block that very many fingerprints
share is split again the same way: its own bits are equal, so the remaining bits hold all differences, and one
of 4 blocks of these is equal too. Each split fixes a quarter of the remaining bits, so groups become small
without a cap: after six splits at most ``2**12`` fingerprints can differ at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, written

SEED = 42
#: Shingles whose hashes are held at once.
AT_ONCE = 1 << 20
#: The bits of each byte, low ones first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: A block with more fingerprints is split again.
MOST = 2048
#: Splits after which groups are small whatever the data.
SPLITS = 6


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of a text: bit b is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    parts = text.lower().split()  # of bytes: A-Z only, and white space as in [\x20\x09-\x0D]
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=starts[1:])
    n = max(1, len(parts) - words + 1)
    ends = starts[len(parts) - n + 1 :] - 1
    seen = np.zeros((8, 256), np.int64)  # how often each byte of the hashes has each value
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        a, b = starts[at : min(at + AT_ONCE, n)].tolist(), ends[at : at + AT_ONCE].tolist()
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        seen += [np.bincount(c, minlength=256) for c in h.view(np.uint8).reshape(-1, 8).T]
    ones = (seen @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def split(mask: int) -> list[int]:
    """The 4 masks that fix a quarter of the bits that ``mask`` leaves open, and those of ``mask``."""
    left = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(left) / 4) for k in range(5)]
    return [mask | sum(1 << b for b in left[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(prints: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the fingerprints that differ in at most ``most`` bits: as many pairs as links are needed."""
    left = prints
    while len(left):
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            p, todo = todo[0], todo[1:]
            near = np.bitwise_count(left ^ p) <= most
            if near.any():
                yield from ((int(p), q) for q in left[near].tolist())
                todo, left = np.concatenate([todo, left[near]]), left[~near]


def links(prints: DataFrame, bits: int = 3, most: int = MOST) -> DataFrame:
    """(src, dst) between fingerprints (``fp``: long, each once) such that any two within ``bits`` (at most 3) bits are connected."""
    if not 0 <= bits <= 3:
        raise ValueError("4 blocks find up to 3 differing bits")
    spark = prints.sparkSession

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [p for group in b.column(0) for p in linked(group.values.to_numpy().view(np.uint64), bits)]
            flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["src", "dst"])

    masks, rows, found = [0], prints.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    for depth in range(SPLITS):
        # at most 4**6 rows: the masks depend on nothing but the depth
        table = spark.createDataFrame([(_signed(m), [_signed(x) for x in split(m)]) for m in masks], "mask long, masks array<long>")
        masks = [x for m in masks for x in split(m)]
        keyed = rows.join(F.broadcast(table), "mask").select(F.explode("masks").alias("mask"), "fp").withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))
        hot = keyed.groupBy("mask", "block").agg(F.count("*").alias("size")).where(F.col("size") > (most if depth < SPLITS - 1 else 1 << 62))
        tagged = written(keyed.join(hot, ["mask", "block"], "left"), f"blocks-{depth}")
        groups = tagged.where("size is null").groupBy("mask", "block").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found.append(groups.select("fps").mapInArrow(match, "src long, dst long"))
        rows = tagged.where("size is not null").select("mask", "fp")
        if not rows.limit(1).count():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return written(out.distinct(), "simhash-links")


def simhash(docs: DataFrame, bits: int = 3, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, fingerprint, component_id).

    The fingerprint (16 lower-case hex digits) is over the 3-word shingles of the whole text; null texts and texts
    without words have fingerprint zero and are linked like any other. Rows link when their fingerprints differ in
    at most ``bits`` bits; component_id is the smallest doc_id reachable by links, the own one included. A row
    without a doc_id passes links on but names no component; it is null where no row of a component has an id.
    Repeated rows are rows of their own with one fingerprint; rows of one doc_id with unlike texts are not linked
    by it. Other columns are ignored; an empty table gives one."""
    small_batches(docs.sparkSession, 1000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = written(texts.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(prints.select("fp"), bits, most))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "class").select("fp", "component_id"), "simhash-classes")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
