"""Jaccard join of word-shingle sets by size-banded tiles, exact but for collisions of 64-bit hashes.

Equal sets are one class. A class puts its rarest shingles (as many as a partner must share one of) into
tiles; a tile holds classes that share a shingle, in order of set size, and ends where sizes leave a gap that no
pair can bridge. First each class is held against one hub of its tiles, then against the one of another part that its
bitmap says is nearest, then any two parts are held against each other by the few pairs that their bitmaps say are
nearest; what these link needs no more pairs. Then tiles propose every other pair between parts not yet linked that
may match by size, place and bitmap. Pairs pass a second bound from bitmaps as wide as their sets
are large before their sorted sets are intersected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_slots, partitions, slot_bits, slot_filter, small_batches, written
from .shingles import K, each, mix

RARITY_BITS = 22  # the table of how often shingles repeat has as many slots as these high bits tell apart
HELD = 1 << 18  # shingles that a task counts at once, and pairs that it holds
BITS = 512
TILE = 4096
PAIRS = 1 << 15  # pairs whose bitmaps are held against each other at once
AT_ONCE = 1 << 15  # classes of tiles that are read at once
FEW = 8  # pairs by which two parts are held against each other first


def _needed(n, percent: int):
    """Shingles that a set of n shares at least with any partner."""
    return (percent * n + 99) // 100


def _class(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        a, b = int(s.sum(dtype=np.uint64)), int(mix(s ^ K).sum(dtype=np.uint64))
        return int(mix(np.array([a * 3 + b * 0x9E3779B97F4A7C15 + len(s) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fine_bits(n: int) -> int:
    """Bits of the wide bitmap of a set of n: a power of two, four to eight times n."""
    return max(BITS, 1 << (4 * n - 1).bit_length())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls, bits, fine, slot, times): a row for each document with the bitmaps of its set; and for shingles
    that a task meets in several sets, how often, by their slot in a fixed table. A shingle of many sets is met so in
    some task, however many there are; lone ones take no room."""
    kinds = (("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bits", pa.binary()), ("fine", pa.binary()), ("slot", pa.int32()), ("times", pa.int64()))
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def repeated() -> pa.RecordBatch:
            tok, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            tok, times = tok[times > 1], times[times > 1]
            held.clear()
            slot = pa.array((tok >> np.uint64(64 - RARITY_BITS)).astype(np.int32))
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(tok), t) for _, t in kinds[:5]), slot, pa.array(times)], schema=schema)

        for b in batches:
            n, cls, bits, fine = [], [], [], []
            for _, s in each(b):
                c = _class(s) if len(s) else None
                n.append(len(s))
                cls.append(c)
                bits.append(bitmap(s, BITS))
                fine.append(bitmap(s, fine_bits(len(s))))
                if c is not None and c not in done:
                    done.add(c)
                    held.append(s)
                    size += len(s)
                    if size > HELD:
                        yield repeated()
                        done.clear()
                        size = 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(x, t) for x, (_, t) in zip((n, cls, bits, fine), kinds[1:5], strict=True)), *(pa.nulls(len(n), t) for _, t in kinds[5:])], schema=schema)
        yield repeated()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cls long, bits binary, fine binary, slot int, times long")


def _prefixes(b: pa.RecordBatch, rare: np.ndarray, percent: int, done: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, size, its rarest shingles: one of which any partner shares) of the sets not done before."""
    for _, s in each(b, "text"):
        if len(s) and (c := _class(s)) not in done:
            if len(done) > 500_000:
                done.clear()
            done.add(c)
            p = len(s) - _needed(len(s), percent) + 1
            yield c, len(s), s[np.argsort(rare[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], kind="stable")[:p]]


def tiles(docs: DataFrame, rare: np.ndarray, percent: int) -> DataFrame:
    """(tok, part, more, cls, n, pos): a row for each tile of at most TILE classes that share the shingle ``tok``, by size.

    ``more`` says that the classes around these sizes take several tiles. Shingles that only one set puts forward
    are kept out of the shuffle by a filter made from exact counts (it lets a few through, which do no harm)."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            found = list(_prefixes(b, rare, percent, done))
            if found:
                cls, n, toks = zip(*found, strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, toks)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(toks).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int32()), lists], ["cls", "n", "toks"])

    first = written(docs.select("text").mapInArrow(firsts, "cls long, n int, toks array<long>"), "prefixes")
    twice = first.select(F.explode("toks").alias("key")).groupBy("key").count().where("count > 1")
    twice = written(twice.select("key"), "keys")
    high = slot_bits(twice.count())
    wanted = slot_filter(twice, high)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, (tok,) = _lists(b, range(2, 3))
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            hit = in_slots(wanted, tok.view(np.uint64), high)
            row, cls, n = row[hit], b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(tok[hit]), pa.array(cls[row]), pa.array(n[row]), pa.array(pos[hit].astype(np.int32))], ["tok", "cls", "n", "pos"])

    schema = pa.schema([("tok", pa.int64()), ("part", pa.int32()), ("more", pa.bool_()), *((k, pa.list_(t)) for k, t in (("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        part = 0  # of the first run in what is held, if it has begun before

        def cut(cols: list[np.ndarray], last: bool) -> tuple[list, list[np.ndarray] | None]:
            """Tiles of the runs that have ended, and the rest."""
            nonlocal part
            tok, c, n, pos = cols
            new = np.ones(len(tok), bool)  # rows of the same class in a run are one
            new[1:] = (tok[1:] != tok[:-1]) | (c[1:] != c[:-1])
            tok, c, n, pos = tok[new], c[new], n[new], pos[new]
            ends_here = (tok[1:] != tok[:-1]) | (n[1:].astype(np.int64) * percent > n[:-1].astype(np.int64) * 100)
            starts = np.flatnonzero(np.concatenate([[True], ends_here]))
            ends = np.append(starts[1:], len(tok))
            ended = len(starts) if last else len(starts) - 1  # the last run may go on in the next batch
            size = ends - starts
            out = []
            for i in np.flatnonzero((size[:ended] >= 2) | ((np.arange(ended) == 0) & (part > 0))).tolist():
                k = part if i == 0 else 0
                more = k > 0 or size[i] > TILE
                for a in range(starts[i], ends[i], TILE):
                    e = min(a + TILE, ends[i])
                    out.append((tok[a], k, more, c[a:e], n[a:e], pos[a:e]))
                    k += 1
            if ended:
                part = 0
            if last:
                return out, None
            a = int(starts[-1])
            while len(tok) - a > 2 * TILE:
                out.append((tok[a], part, True, *(x[a : a + TILE] for x in (c, n, pos))))
                part, a = part + 1, a + TILE
            return out, [x[a:] for x in (tok, c, n, pos)]

        def batch(out: list) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0] + [len(o[3]) for o in out]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([o[k] for o in out]))) for k in (3, 4, 5)]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.bool_()))] + lists, schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            out, held = cut(cols, False)
            if out:
                yield batch(out)
        if held and len(held[0]):
            out, _ = cut(held, True)
            if out:
                yield batch(out)

    found = first.mapInArrow(rows, "tok long, cls long, n int, pos int")
    found = found.repartition(partitions(docs.sparkSession), "tok").sortWithinPartitions("tok", "n", "cls")
    return found.mapInArrow(gather, "tok long, part int, more boolean, cls array<long>, n array<int>, pos array<int>")


_PAIR = "a long, b long"


def _lists(batch: pa.RecordBatch, columns: range) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each value's row, and the values of these list columns one after another."""
    size = pc.list_value_length(batch.column(columns[0])).to_numpy(zero_copy_only=False).astype(np.int64)
    values = [batch.column(k).flatten() for k in columns]
    return np.repeat(np.arange(len(size)), size), [np.frombuffer(b"".join(v.to_pylist()), np.uint64).reshape(len(v), -1) if pa.types.is_binary(v.type) else v.to_numpy(zero_copy_only=False).astype(np.int64) for v in values]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, so few at once that their lists hold AT_ONCE values or are one row's."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(upto):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            yield b.slice(at, end - at)
            at = end


def few_pairs(tiled: DataFrame, percent: int) -> DataFrame:
    """Each class with one other: of the classes of least hash in its tiles and of a size that may match, the least.

    So the pairs are as many as the classes at most, and the classes of one group mostly choose the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 0):
            row, (c, m) = _lists(batch, range(2))
            if len(c):
                rank = mix(c.view(np.uint64))
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(row))))
                at = np.flatnonzero(rank == least)  # one of each row, as its classes differ
                hub = at[np.searchsorted(row[at], row)]
                near = np.flatnonzero((m * 100 >= percent * m[hub]) & (m[hub] * 100 >= percent * m) & (hub != np.arange(len(c))))
                near = near[np.lexsort((rank[hub[near]], c[near]))]
                near = near[np.concatenate([[True], c[near][1:] != c[near][:-1]])] if len(near) else near
                yield pa.RecordBatch.from_arrays([pa.array(c[near]), pa.array(c[hub[near]]), pa.array((rank[hub[near]] >> np.uint64(1)).astype(np.int64))], ["a", "b", "rank"])

    chosen = tiled.select("cls", "n").mapInArrow(run, f"{_PAIR}, rank long").groupBy("a").agg(F.min_by("b", "rank").alias("b"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _told(tiled: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """(tok, part, more, low, high, xs) of the tiles, with the part of each class.

    parts: (cls, comp) of every class, and what else goes along."""
    flat = tiled.select("tok", "part", "more", F.explode(F.arrays_zip("cls", "n", "pos")).alias("x")).select("tok", "part", "more", "x.*")
    told = flat.join(parts.select("cls", "comp", *more), "cls").groupBy("tok", "part", "more")
    told = told.agg(F.sort_array(F.collect_list(F.struct("n", "cls", "pos", "comp", *more))).alias("xs"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return told


_LISTS = ("cls", "n", "pos", "comp", "bits")


def rest_pairs(tiled: DataFrame, parts: DataFrame | None, percent: int, best: bool, few: int = 0) -> DataFrame:
    """Every pair of a tile, or of two tiles of one shingle, that lies in different parts and may match by size, position and bitmap.

    With ``best``, only the one of each class whose likeness by bitmap is the highest; with ``few``, only so many of any
    two parts, the likest, so that a large part and those near it are linked before all their pairs are held.
    Without ``parts``, tiled is what ``told_tiles`` made with them."""
    found = proposals(tiled, parts, percent, best, few)
    if best:
        found = found.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b"))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not few:
        return found.distinct()
    likest = F.slice(F.sort_array(F.collect_set(F.struct("like", "a", "b")), asc=False), 1, few)
    return found.groupBy("p", "q").agg(likest.alias("x")).select(F.explode("x").alias("x")).select("x.a", "x.b")


def told_tiles(tiled: DataFrame, parts: DataFrame) -> DataFrame:
    """The tiles in which parts differ or which go on, with the part and bitmap of each class. Parts only grow, so the others propose no pair from now on."""
    told = _told(tiled, parts, "bits").where("more or low != high")
    return written(told.select("tok", "part", "more", "low", "high", *(F.col("xs")[k].alias(k) for k in _LISTS)), "told")


def proposals(tiled: DataFrame, parts: DataFrame | None, percent: int, best: bool, few: int = 0) -> DataFrame:
    """What each task finds of these pairs, brought together within the task: (a, b); with ``best`` a row for each class and
    its likeness, with ``few`` so many rows at most for two parts (p, q) and their likeness."""
    told = tiled if parts is None else told_tiles(tiled, parts)
    names = ["a", "b", "like"] if best else ["p", "q", "a", "b", "like"] if few else ["a", "b"]
    of, most_rows = (1, 1) if best else (2, few)  # so many rows are kept for equal values of the first columns
    none = [F.lit(None).cast(told.schema[k].dataType).alias(f"{k}2") for k in _LISTS]
    one = told.where("low != high").select(*_LISTS, *none)
    split = told.where("more").withColumns({"least": F.element_at("n", 1), "most": F.element_at("n", -1)})
    other = split.select("tok", *(F.col(k).alias(f"{k}2") for k in ("part", "least", "most", "low", "high", *_LISTS)))
    near = (F.col("part") < F.col("part2")) & (F.col("least") * percent <= F.col("most2") * 100) & (F.col("least2") * percent <= F.col("most") * 100)
    apart = F.least("low", "low2") != F.greatest("high", "high2")
    two = split.join(other, "tok").where(near & apart).select(*one.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task has found is brought together before it leaves, so a class that stands in many tiles or is held against many others is one row."""
        held: list[tuple[np.ndarray, ...]] = []
        size = kept = 0

        def together() -> tuple[np.ndarray, ...]:
            found = [np.concatenate(x) for x in zip(*held, strict=True)]
            if best or few:  # the likest come first
                by = np.lexsort((*found[-2:of - 1 : -1], -found[-1], *found[of - 1 :: -1]))
            else:
                by = np.lexsort(found[::-1])
            found = [x[by] for x in found]
            new = _changes(*found)  # the same pair from another tile
            found = [x[new] for x in found]
            if best or few:
                first = np.flatnonzero(_changes(*found[:of]))
                size = np.diff(np.append(first, len(found[0])))
                found = [x[np.arange(len(x)) - np.repeat(first, size) < most_rows] for x in found]
            return tuple(found)

        for found in (f for batch in batches for f in pairs_of(batch)):
            held.append(found)
            size += len(found[0])
            if size >= kept + HELD:
                held = [together()]
                size = kept = len(held[0][0])
                if kept >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names)
                    size = kept = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in together()], names)

    def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for same in (True, False):
            for part in _parts([batch.filter(pc.equal(pc.is_null(batch.column(5)), same))], 0):
                row, mine = _lists(part, range(5))
                yield from met(row, mine, *((row, mine) if same else _lists(part, range(5, 10))), same)

    def met(row: np.ndarray, mine: list, row2: np.ndarray, theirs: list, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        c, n, pos, comp, x = mine
        c2, n2, pos2, comp2, y = theirs
        key = row2 << 32 | n2  # rows are in order of size
        hi = np.searchsorted(key, row << 32 | n * 100 // percent, side="right")
        lo = np.arange(len(c)) + 1 if same else np.searchsorted(key, row << 32 | _needed(n, percent))
        count = np.maximum(hi - lo, 0)
        upto = np.cumsum(count)
        at = 0
        while at < len(c):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            k = count[at:end]
            i = np.repeat(np.arange(at, end), k)
            j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:end], k)
            ok = comp[i] != comp2[j]
            i, j = i[ok], j[ok]
            most = 1 + np.minimum(n[i] - pos[i] - 1, n2[j] - pos2[j] - 1)
            ok = most * (100 + percent) >= percent * (n[i] + n2[j])
            i, j = i[ok], j[ok]
            most = _bound(x[i], y[j], n[i], n2[j])  # alike in all tiles of a pair, as places are not
            ok = most * (100 + percent) >= percent * (n[i] + n2[j])
            i, j, most = i[ok], j[ok], most[ok]
            like = most / (n[i] + n2[j] - most)
            if best and len(i):
                yield np.concatenate([c[i], c2[j]]), np.concatenate([c2[j], c[i]]), np.concatenate([like, like])
            elif len(i):
                pair = np.minimum(c[i], c2[j]), np.maximum(c[i], c2[j])
                yield (np.minimum(comp[i], comp2[j]), np.maximum(comp[i], comp2[j]), *pair, like) if few else pair
            at = end

    return one.unionByName(two).mapInArrow(run, ", ".join(f"{k} {'double' if k == 'like' else 'long'}" for k in names))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _bound(x: np.ndarray, y: np.ndarray, n, m) -> np.ndarray:
    """Most shingles that sets of n and m with these bitmaps can share: each bit of one only is a shingle of one only."""
    return np.minimum(n - np.bitwise_count(x & ~y).sum(axis=-1), m - np.bitwise_count(y & ~x).sum(axis=-1))


def _fine_bound(x: bytes, y: bytes, n: int, m: int) -> int:
    """The same from bitmaps as wide as their sets ask for: the wider one is folded to the other's width."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    if len(a) != len(b):
        w = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(v.reshape(-1, w), axis=0) for v in (a, b))
    return int(_bound(a, b, n, m))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """The pairs (a, b: classes) whose sets match, as (src, dst): the smallest doc_id of either class.

    reps: (cls, rep, n, bits, fine). Pairs pass the bounds of both bitmaps; then the texts of the documents that
    stand for the classes meet and their sets are intersected. Filters keep most other bitmaps and texts from being
    shuffled; they only save work. ``repeated`` says that several rows may have one doc_id."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (2, 3))
                n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
                yield b.filter(pa.array(_bound(x, y, n, m) * (100 + percent) >= percent * (n + m))).select(["a", "b"])

    left, right = (reps.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    may = pairs.join(left, "a").join(right, "b").select("a", "b", "bitsa", "bitsb", "na", "nb")
    may = written(may.mapInArrow(bounded, _PAIR), "pairs")

    def wanted_rows(source: DataFrame, wanted: np.ndarray, high: int) -> DataFrame:
        """The rows whose first column, hashed in the last one, may be wanted."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_slots(wanted, b.column(b.num_columns - 1).to_numpy().view(np.uint64), high)))

        return source.mapInArrow(run, source.schema).drop("key")

    def slots(pairs: DataFrame, *ends: str) -> tuple[np.ndarray, int]:
        high = slot_bits(len(ends) * pairs.count())
        return slot_filter(pairs.select(F.explode(F.array(*ends)).alias("end")).select(F.xxhash64("end").alias("key")), high), high

    fine = wanted_rows(reps.select("cls", "rep", "n", "fine", F.xxhash64("cls").alias("key")), *slots(may, "a", "b"))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(6).to_numpy(), b.column(7).to_numpy()
            most = [_fine_bound(x, y, i, j) for x, y, i, j in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), n.tolist(), m.tolist(), strict=True)]
            yield b.filter(pa.array(np.array(most, np.int64) * (100 + percent) >= percent * (n + m), pa.bool_())).select(["a", "src", "b", "dst"])

    both = may.join(fine.toDF("a", "src", "na", "x"), "a").join(fine.toDF("b", "dst", "nb", "y"), "b")
    may = written(both.select("a", "src", "b", "dst", "x", "y", "na", "nb").mapInArrow(finer, "a long, src long, b long, dst long"), "near")
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text")).where("doc is not null").withColumn("key", F.xxhash64("doc"))
    texts = wanted_rows(source, *slots(may, "src", "dst"))
    if repeated:
        texts = texts.distinct()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A repeated id brings several texts: only those of the classes that are meant count."""
        for b in batches:
            src, dst = [], []
            sets = [list(each(b.select([k]), k)) for k in ("x", "y")]
            for s, d, a, c, (_, x), (_, y) in zip(*(b.column(k).to_pylist() for k in range(4)), *sets, strict=True):
                if repeated and (not len(x) or not len(y) or _class(x) != a or _class(y) != c):
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    src.append(s)
                    dst.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    links = may.join(texts.toDF("src", "x"), "src").join(texts.toDF("dst", "y"), "dst").select("src", "dst", "a", "b", "x", "y")
    return written(links.mapInArrow(match, "src long, dst long").distinct() if repeated else links.mapInArrow(match, "src long, dst long"), "links")


def jaccard_join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_shingles, component_id).

    Two rows link when 100 * intersection >= percent * union of their sets of 5-word shingles;
    component_id is the smallest doc_id reachable. Null and empty texts have no shingles and link with
    nothing, so they keep their own id. Rows that share a doc_id count as linked. Rows without a doc_id
    link with nothing and get a null component_id. Other columns are ignored; an empty table gives one."""
    small_batches(docs.sparkSession, size="1m")
    first = written(classes(docs), "classes")
    members = first.where("slot is null").select("doc_id", "n", "cls", "bits", "fine")
    rare = np.zeros(1 << RARITY_BITS, np.uint8)
    level = F.floor(4 * F.log2(F.sum("times"))).cast("int")
    counted = first.where("slot is not null").groupBy("slot").agg(F.least(level, F.lit(255)).alias("level")).toArrow()  # a row for each slot at most
    rare[counted["slot"].to_numpy()] = counted["level"].to_numpy()
    named = members.where("cls is not null and doc_id is not null")
    stand = F.min_by(F.struct("n", "bits", "fine"), "doc_id")
    reps = named.groupBy("cls").agg(F.min("doc_id").alias("rep"), stand.alias("x")).select("cls", "rep", "x.*")
    reps = written(reps, "reps")
    repeated = members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    some = repeated.limit(1).count() > 0
    tiled = written(tiles(docs, rare, percent), "tiles")
    links = verified(few_pairs(tiled, percent), docs, reps, percent, some)
    tried = None
    for best, few in ((True, 0), (False, FEW), (False, 0)):
        found = components(links)
        parts = reps.join(found, reps["rep"] == found["node"], "left").select("cls", "bits", F.xxhash64(F.coalesce("component", "rep")).alias("comp"))
        tiled = told_tiles(tiled, parts)
        pairs = rest_pairs(tiled, None, percent, best, few)
        if few:
            pairs = tried = written(pairs, "tried")
        elif tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        links = links.union(verified(pairs, docs, reps, percent, some))
    if some:  # the other classes of a repeated id are linked with the class it stands for
        shared = named.join(reps.select("cls", "rep"), "cls").where("doc_id != rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
        links = links.union(shared.join(repeated, shared["src"] == repeated["doc_id"], "left_semi"))
    found = components(links)
    out = members.select("doc_id", "n", "cls").join(reps.select("cls", "rep"), "cls", "left").withColumn("own", F.coalesce("rep", "doc_id"))
    out = out.join(found, F.col("own") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own")).alias("component_id"))
