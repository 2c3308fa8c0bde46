"""Overlay of polygons (union, intersection, difference, repair) as joins and windows over edges.

Shapes are rows with ``rings`` (array of rings of points, even-odd rule) and are cut at tiles. A task splits its tiles
while they hold many edges and drops what lies below a shape that covers all of a part (``strips``). In each part, x is
divided at all vertices and crossings of edges. Between two neighbouring x no edges cross, so sorting them by height and
counting how many shapes each one enters or leaves gives the covered trapezoids. Their areas add up to the result's
area. Their sides, added up as signed segments, cancel wherever two trapezoids meet, across tiles too: what remains
is the outline, and its segments are joined end to start into rings.

A tile with very many edges is split among tasks, so a dense place is many keys. Every other step is a join, an aggregate
or a window with the tile in its key; only the points of one ring come together in one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import geometry as G
from terrafold.operators import strips
from terrafold.operators.ranges import written

#: A tile with more edges is split in four and each part goes to a task by itself, at most so many times.
DENSE, PARTS = 200_000, 6
#: Within a task a tile with more edges is split on, at most so many times (edges that meet in one point stay together).
MOST_EDGES, SPLITS = 64, 12
#: Shapes of more points are cut at tiles.
SMALL = 256
#: Rows of pieces that a task works on at once.
ROWS = 20_000
#: Heights and crossings are multiples of this (a power of two: exact for coordinates below 8 million).
GRID = strips.GRID

RULES = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
    "exclusive": lambda a, b: (a > 0) != (b > 0),
}


def rings_of(vertices: DataFrame, *keys: str) -> DataFrame:
    """(keys, rings) from a row for each vertex (keys, ring, pos, x, y); a ring's points come in the order of ``pos``.

    Vertices are dealt out by shape once, which does for the rings too."""
    point = F.struct("pos", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    rings = vertices.repartition(*keys).groupBy(*keys, "ring").agg(F.transform(F.array_sort(F.collect_list(point)), lambda v: v["p"]).alias("points"))
    ordered = F.array_sort(F.collect_list(F.struct("ring", "points")))
    return rings.groupBy(*keys).agg(F.transform(ordered, lambda r: r["points"]).alias("rings"))


def _clipped(rings: Column, x: Column, y: Column, size: Column) -> Column:
    cut = F.transform(rings, lambda r: G.clipped_ring(r, x, y, x + size, y + size))
    return F.filter(cut, lambda r: F.size(r) > 2)


def _within(rings: Column, x: Column, y: Column, size: Column) -> Column:
    """The rings as a tile needs them: small ones as they are (the tile's task takes what lies in it), others cut at the tile."""
    few = F.aggregate(F.transform(rings, F.size), F.lit(0), lambda s, n: s + n) <= SMALL
    b = G.bounds(rings)
    inside = (b["minx"] >= x) & (b["maxx"] <= x + size) & (b["miny"] >= y) & (b["maxy"] <= y + size)
    return F.when(few | inside, rings).otherwise(_clipped(rings, x, y, size))


def in_tiles(shapes: DataFrame, keys: list[str], tile: float, most: int | None = DENSE) -> DataFrame:
    """Shapes dealt out to the tiles they meet: (keys, gid, side, rings, size, tx, ty, base_x, base_y). Null and empty rings have no rows.

    Shapes of many points are cut at the tile, others may reach over its border. ``base_x`` and ``base_y`` number the
    tiles before any is split; without ``most`` none is."""
    shapes = shapes.select(*keys, "gid", "side", F.filter("rings", lambda r: r.isNotNull() & (F.size(r) > 2)).alias("rings")).where(F.size("rings") > 0)
    box = shapes.withColumn("_b", G.bounds(F.col("rings")))
    place = lambda c: F.floor(F.col(c) / tile)
    cells = box.withColumn("tx", F.explode(F.sequence(place("_b.minx"), place("_b.maxx")))).withColumn("ty", F.explode(F.sequence(place("_b.miny"), place("_b.maxy")))).drop("_b")
    size = F.lit(float(tile))
    cells = cells.withColumn("rings", _within(F.col("rings"), F.col("tx") * size, F.col("ty") * size, size))
    cells = cells.withColumns({"size": size, "base_x": F.col("tx"), "base_y": F.col("ty")})
    done = []
    group = [*keys, "size", "tx", "ty"]
    for _ in range(PARTS if most is not None else 0):
        cells = written(cells, "tiles")
        edges = F.aggregate(F.transform("rings", F.size), F.lit(0), lambda s, n: s + n)
        dense = cells.groupBy(*group).agg(F.sum(edges).alias("edges")).where(F.col("edges") > most).drop("edges")
        if not dense.limit(1).count():
            break
        done.append(cells.join(dense, group, "left_anti"))
        half = F.col("size") / 2
        parts = cells.join(dense, group, "left_semi").withColumn("_b", G.bounds(F.col("rings"))).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
        parts = parts.withColumns({"tx": F.col("tx") * 2 + F.col("i"), "ty": F.col("ty") * 2 + F.col("j"), "size": half}).drop("i", "j")
        low = lambda t: F.col(t) * F.col("size")
        parts = parts.where((F.col("_b.minx") < low("tx") + F.col("size")) & (F.col("_b.maxx") > low("tx")) & (F.col("_b.miny") < low("ty") + F.col("size")) & (F.col("_b.maxy") > low("ty"))).drop("_b")
        cells = parts.withColumn("rings", _within(F.col("rings"), low("tx"), low("ty"), F.col("size")))
    for d in done:
        cells = cells.unionByName(d)
    return cells


def snapped(v: Column) -> Column:
    """The nearest multiple of GRID: what differs by rounding only becomes equal."""
    return F.floor(v / GRID + 0.5) * GRID


def sides_of(pieces: DataFrame) -> DataFrame:
    """A row for each side (ax, ay, bx, by) of the rings, in their direction; ``eid`` numbers a shape's sides."""
    after = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    side = lambda a, b: F.struct(*(snapped(p[c]).alias(f"{n}{c}") for n, p in (("a", a), ("b", b)) for c in "xy"))
    pairs = F.flatten(F.transform("rings", lambda r: F.zip_with(r, after(r), side)))
    out = pieces.select(*(c for c in pieces.columns if c != "rings"), F.posexplode(pairs).alias("eid", "e"))
    return out.select(*(c for c in out.columns if c != "e"), "e.*").where("ax != bx or ay != by")


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike."""
    try:
        codes = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return codes[1:] != codes[:-1]
    except pa.ArrowNotImplementedError:
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values[1:], values, strict=False)], bool)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, equal for equal ones."""
    try:
        return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    except pa.ArrowNotImplementedError:
        return np.unique([repr(v) for v in column.to_pylist()], return_inverse=True)[1]


def _cells_of(rows: pa.Table, group: list[str]) -> tuple[np.ndarray, strips.Sides, tuple[np.ndarray, ...]]:
    """The first row of each group, all sides, and the groups as cells: number, size, tx, ty, and the cell of each side."""
    new = np.append(True, np.any([_changes(rows[c]) for c in group], axis=0)) if rows.num_rows > 1 else np.ones(rows.num_rows, bool)
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    rings = rows["rings"].combine_chunks()
    rings = rings.chunk(0) if isinstance(rings, pa.ChunkedArray) else rings
    inner = rings.values
    points, upto, of = inner.values, inner.offsets.to_numpy(), rings.offsets.to_numpy()
    x, y = (strips.snapped(points.field(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
    length = np.diff(upto)
    after = np.arange(1, len(x) + 1)
    after[upto[1:][length > 0] - 1] = upto[:-1][length > 0]
    row = np.repeat(np.repeat(np.arange(len(of) - 1), np.diff(of)), length)
    ax, ay, bx, by = x, y, x[after], y[after]
    on = ((ax != bx) | (ay != by)) & ~np.isnan(ax + ay + bx + by)
    ax, ay, bx, by, row = (v[on] for v in (ax, ay, bx, by, row))
    right = ax <= bx
    ends = [np.where(right, a, b) for a, b in ((ax, bx), (ay, by), (bx, ax), (by, ay))]
    side = rows["side"].to_numpy().astype(np.int64)
    gid = _codes(rows["gid"])
    _, one, shape = np.unique(np.stack([number, side, gid]), axis=1, return_index=True, return_inverse=True)
    sides = strips.Sides(*ends, shape.ravel()[row], side[one])
    cells = (np.arange(len(first)), *(rows[c].to_numpy()[first] for c in ("size", "tx", "ty")), number[row])
    return first, sides, cells


def _worked(pieces: DataFrame, keys: list[str], alone: bool, made, schema: str) -> DataFrame:
    """What ``made`` (rows of whole groups: their first rows, sides, cells) makes of the pieces' groups, many small ones at a time.

    ``alone``: the rows of a group follow one another in a partition already, so none is shuffled."""
    group = [*keys, "size", "tx", "ty"]
    if not alone:
        pieces = pieces.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < ROWS and held.nbytes < ROWS << 8:
                continue
            changes = np.flatnonzero(np.any([_changes(held[c]) for c in group], axis=0)) if held.num_rows > 1 else []
            if len(changes):  # the last group may go on
                done = int(changes[-1]) + 1
                whole, held = held.slice(0, done), pa.Table.from_batches(held.slice(done).combine_chunks().to_batches())
                yield from made(whole.combine_chunks(), *_cells_of(_fresh(whole), group))
        if held is not None and held.num_rows:
            yield from made(held, *_cells_of(_fresh(held), group))

    names = [*keys, *(c for c in ("size", "tx", "ty", "base_x", "base_y", "gid", "side", "rings") if c in pieces.columns)]
    return pieces.select(*names).mapInArrow(run, schema)


def _fresh(rows: pa.Table) -> pa.Table:
    """The rows in arrays of their own, that begin at 0."""
    return rows.take(pa.array(np.arange(rows.num_rows)))


def _types(pieces: DataFrame, columns: list[str]) -> str:
    """The schema text of some columns."""
    return ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)


def trapezoids(pieces: DataFrame, keys: list[str], rule: str, most: int = MOST_EDGES, alone: bool = False) -> DataFrame:
    """What the rule covers, as trapezoids between xa and xb: bl and br are the lower ends, tl and tr the upper ones, low and high the sides.

    ``pieces`` come from ``in_tiles``. A shape (gid, side 0 or 1) covers what its rings enclose an odd number of times."""
    kept = [*keys, "base_x", "base_y"]

    def made(rows: pa.Table, first: np.ndarray, sides: strips.Sides, cells: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for c in strips.leaves(sides, *cells, most, SPLITS):
            for cell, xa, xb, bl, br, low, tl, tr, high in strips.strips(sides, c, RULES[rule]):
                at = pa.array(first[c.group[cell]])
                own = [rows[k].take(at).combine_chunks() for k in kept]
                own = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in own]
                rest = [pa.array(v) for v in (c.size[cell], c.tx[cell], c.ty[cell], xa, xb, bl, br, low, tl, tr, high)]
                yield pa.RecordBatch.from_arrays([*own, *rest], [*kept, "size", "tx", "ty", "xa", "xb", "bl", "br", "low", "tl", "tr", "high"])

    schema = f"{_types(pieces, kept)}, size double, tx long, ty long, xa double, xb double, bl double, br double, low long, tl double, tr double, high long"
    return _worked(pieces, keys, alone, made, schema)


def _areas(pieces: DataFrame, keys: list[str], rule: str, most: int = MOST_EDGES, alone: bool = False) -> DataFrame:
    """(keys, area) of what the rule covers; keys without any have no row."""

    def made(rows: pa.Table, first: np.ndarray, sides: strips.Sides, cells: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(len(first)), np.zeros(len(first), bool)
        for c in strips.leaves(sides, *cells, most, SPLITS):
            for cell, xa, xb, bl, br, _, tl, tr, _ in strips.strips(sides, c, RULES[rule]):
                total += np.bincount(c.group[cell], ((tl + tr) - (bl + br)) / 2 * (xb - xa), len(first))
                some[c.group[cell]] = True
        at = pa.array(first[some])
        own = [rows[k].take(at).combine_chunks() for k in keys]
        own = [v.chunk(0) if isinstance(v, pa.ChunkedArray) and v.num_chunks else v for v in own]
        if some.any():
            yield pa.RecordBatch.from_arrays([*own, pa.array(total[some])], [*keys, "area"])

    types = _types(pieces, keys)
    return _worked(pieces, keys, alone, made, f"{types}{', ' if types else ''}area double").groupBy(*keys).agg(F.sum("area").alias("area"))


def _named(shapes: DataFrame, keys: list[str]) -> tuple[list[str], DataFrame]:
    """Names for the keys that clash with no other column here, and the shapes with these."""
    own = [f"_key{i}" for i in range(len(keys))]
    return own, shapes.select(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True)), "gid", "side", "rings")


def overlay_area(shapes: DataFrame, keys: list[str], tile: float, rule: str = "union", most: int = MOST_EDGES) -> DataFrame:
    """(keys, area): area of the union (or another rule) of each key's shapes (keys, gid, side, rings); keys without area have no row."""
    own, shapes = _named(shapes, keys)
    areas = _areas(in_tiles(shapes, own, tile), own, rule, most)
    return areas.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def outline(pieces: DataFrame, keys: list[str], rule: str, most: int = MOST_EDGES, alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """(keys, ring) around what the rule covers, with the inside on the left: closed rings, and open paths whose ends others meet."""
    kept = [*keys, "kind", "base", "line", "at", "step", "ring"]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def made(rows: pa.Table, first: np.ndarray, sides: strips.Sides, cells: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        _, size, tx, ty, _ = cells
        tile = (tx * size, ty * size, (tx + 1) * size, (ty + 1) * size)
        found = []
        for c in strips.leaves(sides, *cells, most, SPLITS):
            low, high = c.ty * c.size, (c.ty + 1) * c.size
            found += [(c.group[cell], *rest, low[cell], high[cell]) for cell, *rest in strips.strips(sides, c, RULES[rule])]
        if not found:
            return
        group, *rest, low, high = (np.concatenate(v) for v in zip(*found, strict=True))
        segments, level, upright = strips.outlines(group, tuple(rest), low, high, tile)
        none = pa.array([None], pa.list_(point))

        def batch(group: np.ndarray, kind: np.ndarray, base: np.ndarray, line: np.ndarray, at: np.ndarray, step: np.ndarray, ring: pa.Array) -> pa.RecordBatch:
            own = [rows[k].take(pa.array(first[group])).combine_chunks() for k in keys]
            own = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in own]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(v) for v in (kind.astype(np.int32), base.astype(np.int64), line, at, step.astype(np.int64))), ring], kept)

        if len(segments[0]):
            group, closed, start, x, y = strips.paths(*segments, tile)
            rings = pa.ListArray.from_arrays(pa.array(np.append(start, len(x)), pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(point)))
            zero = np.zeros(len(group))
            yield batch(group, np.where(closed, 0, 1), zero, zero, zero, zero, rings)
        for kind, base, (group, line, at, step) in ((2, "base_x", level), (3, "base_y", upright)):
            if len(group):
                yield batch(group, np.full(len(group), kind), rows[base].to_numpy()[first][group], line, at, step, none.take(pa.array(np.zeros(len(group), np.int64))))

    types = _types(pieces, keys)
    ring = "array<struct<x:double,y:double>>"
    parts = written(_worked(pieces, keys, alone, made, f"{types}{', ' if types else ''}kind int, base long, line double, at double, step long, ring {ring}"), "outline")

    def left_over(events: DataFrame, point) -> DataFrame:
        """Segments of a line on which the steps so far do not cancel."""
        steps = events.groupBy(*keys, "base", "line", "at").agg(F.sum("step").alias("step")).where("step != 0")
        w = Window.partitionBy(*keys, "base", "line").orderBy("at")
        runs = steps.withColumns({"sum": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "to": F.lead("at").over(w)}).where("sum != 0 and to is not null")
        runs = runs.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.abs("sum").cast("int"))))
        a, b = point("at"), point("to")
        return runs.select(*keys, F.when(F.col("sum") > 0, F.array(a, b)).otherwise(F.array(b, a)).alias("ring"))

    lines = left_over(parts.where("kind = 2"), lambda c: F.struct(F.col(c).alias("x"), F.col("line").alias("y")))
    walls = left_over(parts.where("kind = 3"), lambda c: F.struct(F.col("line").alias("x"), F.col(c).alias("y")))
    of = lambda kind: parts.where(F.col("kind") == kind).select(*keys, "ring")
    return of(0), of(1).unionByName(lines).unionByName(walls)


def _followers(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(eid, next): the path (keys, eid, ring: its points) that goes on where each one ends. Where several meet, the ring turns to the nearest
    one clockwise of the way back, so that it keeps to one side of the point."""
    end = lambda one, two, leaves: segments.select(*keys, one["x"].alias("x"), one["y"].alias("y"), F.atan2(two["y"] - one["y"], two["x"] - one["x"]).alias("angle"), F.lit(leaves).alias("leaves"), "eid")
    at = lambda k: F.element_at("ring", k)
    out, into = end(at(1), at(2), 1), end(at(-1), at(-2), 0)
    node = [*keys, "x", "y"]
    ranked = out.unionByName(into).withColumn("rank", F.row_number().over(Window.partitionBy(*node, "leaves").orderBy("angle", "eid")))
    first = ranked.groupBy(*node).agg(F.min(F.when(F.col("leaves") == 1, F.col("angle"))).alias("least_out"), F.min(F.when(F.col("leaves") == 0, F.col("angle"))).alias("least_in"), F.sum("leaves").alias("many"))
    ins = ranked.where("leaves = 0").join(first, node)
    wanted = F.when(F.col("least_out") <= F.col("least_in"), F.col("rank")).otherwise(F.when(F.col("rank") == 1, F.col("many")).otherwise(F.col("rank") - 1))
    ins = ins.select(*node, F.col("eid"), wanted.alias("rank"))
    return ins.join(ranked.where("leaves = 1").select(*node, F.col("eid").alias("next"), "rank"), [*node, "rank"]).select("eid", "next")


def _named_rings(links: DataFrame) -> DataFrame:
    """(eid, ring, place) for the links (eid, next) of closed rings: the ring's least eid, and places that grow along it.

    Each round doubles how far a segment sees along its ring, so rounds grow with the logarithm of the longest ring. It
    keeps the least eid seen and how many steps away that is."""
    found = F.col("next") < F.col("eid")
    steps = written(links.select("eid", F.col("next").alias("to"), F.least("eid", "next").alias("ring"), found.cast("long").alias("away")), "rings")
    far = 2  # segments in sight, the own one included
    while True:
        # ``to`` is the last one in sight; the next stretch begins there
        ahead = steps.select(F.col("eid").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"), F.col("away").alias("away2"))
        less = F.col("ring2") < F.col("ring")
        new = steps.join(ahead, "to").select("eid", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), F.when(less, F.col("away2") + (far - 1)).otherwise(F.col("away")).alias("away"), less.alias("moved"))
        steps, far = written(new, "rings"), 2 * far - 1
        if not steps.where("moved").limit(1).count():
            return steps.select("eid", "ring", (-F.col("away")).alias("place"))
        steps = steps.drop("moved")


def _tidy(points: Column) -> Column:
    """The ring's points without those on the straight way between their neighbours, spikes and repeats (up to rounding)."""
    near = 16 * GRID

    def neighbours(points: Column, i: Column) -> tuple[Column, Column]:
        n = F.size(points)
        at = lambda k: F.element_at(points, F.pmod(k, n).cast("int") + 1)
        return at(i - 1), at(i + 1)

    def moves(points: Column):
        def keep(p: Column, i: Column) -> Column:
            a, _ = neighbours(points, i)
            return (F.abs(p["x"] - a["x"]) > near) | (F.abs(p["y"] - a["y"]) > near)

        return keep

    def turns(points: Column):
        def keep(p: Column, i: Column) -> Column:
            a, b = neighbours(points, i)
            cross = (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
            far = F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]), F.abs(p["x"] - a["x"]), F.abs(p["y"] - a["y"]))
            return F.abs(cross) > near * far

        return keep

    def kept(points: Column, test) -> Column:
        return F.element_at(F.transform(F.array(points), lambda q: F.filter(q, test(q))), 1)  # so the points are worked out once

    for test in (moves, turns) * 3:
        points = kept(points, test)
    return points


def dissolved(shapes: DataFrame, keys: list[str], tile: float, rule: str = "union", least_m2: float = 1e-6, most: int = MOST_EDGES) -> DataFrame:
    """(keys, ring_id, hole, area, ring): the rings around the union (or another rule) of each key's shapes.

    ``shapes``: (keys, gid, side, rings) with gid unlike for each shape of a key and side 0 or 1. Outer rings run
    counter-clockwise with positive area, holes clockwise with negative area, so areas add up. Rings under ``least_m2``
    (slivers of rounding) are left out. Rings may touch themselves or others in points, but never cross. Shapes that
    are null or have no ring of 3 points cover nothing; repeated shapes count once."""
    own, shapes = _named(shapes, keys)
    rings = _rings(in_tiles(shapes, own, tile), own, rule, least_m2, most)
    return rings.select(*(F.col(n).alias(k) for n, k in zip(own, keys, strict=True)), "ring_id", "hole", "area", "ring")


def _rings(pieces: DataFrame, own: list[str], rule: str, least_m2: float, most: int = MOST_EDGES, alone: bool = False) -> DataFrame:
    """(own keys, ring_id, hole, area, ring) around what the rule covers of pieces cut at tiles."""
    closed, paths = outline(pieces, own, rule, most, alone)
    rings = closed.withColumn("ring_id", F.monotonically_increasing_id() * 2)
    paths = written(paths.withColumn("eid", F.monotonically_increasing_id()), "paths")
    if paths.limit(1).count():
        placed = paths.withColumnRenamed("ring", "points").join(_named_rings(_followers(paths, own)), "eid")
        part = F.struct("place", F.slice("points", 1, F.size("points") - 1).alias("points"))  # the next one has the last point
        joined = placed.groupBy(*own, "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda v: v["points"])).alias("points"))
        rings = rings.select(*own, "ring_id", "ring").unionByName(joined.select(*own, (F.col("ring") * 2 + 1).alias("ring_id"), F.col("points").alias("ring")))
    rings = rings.withColumn("area", G.ring_area(F.col("ring"))).where(F.abs("area") >= least_m2)
    rings = rings.withColumn("ring", _tidy(F.col("ring"))).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    return rings.select(*own, "ring_id", (F.col("area") < 0).alias("hole"), "area", "ring")


def repaired(shapes: DataFrame, key: str, tile: float) -> DataFrame:
    """(key, rings, area): each shape (key, rings) as what its rings enclose an odd number of times, without crossings.

    Bow-ties fall apart into their wings, spikes vanish, rings in rings are holes. A shape without area has no row."""
    one = shapes.select(key, F.lit(0).alias("gid"), F.lit(0).alias("side"), "rings")
    rings = dissolved(one, [key], tile)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("hole"), F.col("ring_id"), F.col("ring"))))
    return rings.groupBy(key).agg(F.transform(ordered, lambda r: r["ring"]).alias("rings"), F.sum("area").alias("area"))


def self_crossing(shapes: DataFrame, key: str) -> DataFrame:
    """(key, crossings) of the shapes (key, rings) in which sides cross between their ends: these need repair."""
    a = sides_of(shapes.select(key, "rings"))
    names = ("eid", "ax", "ay", "bx", "by")
    pairs = a.join(a.withColumnsRenamed({c: f"o_{c}" for c in names}), key).where("eid < o_eid")
    for v in "xy":
        pairs = pairs.where((F.greatest(f"a{v}", f"b{v}") >= F.least(f"o_a{v}", f"o_b{v}")) & (F.greatest(f"o_a{v}", f"o_b{v}") >= F.least(f"a{v}", f"b{v}")))

    def turn(p: str, q: str, r: str) -> Column:
        """Which way r lies from the line p q."""
        x, y = (lambda s: F.col(f"{s}x")), (lambda s: F.col(f"{s}y"))
        return F.signum((x(q) - x(p)) * (y(r) - y(p)) - (y(q) - y(p)) * (x(r) - x(p)))

    crossed = (turn("a", "b", "o_a") * turn("a", "b", "o_b") < 0) & (turn("o_a", "o_b", "a") * turn("o_a", "o_b", "b") < 0)
    return pairs.where(crossed).groupBy(key).agg(F.count("*").alias("crossings"))


def _met(left: DataFrame, right: DataFrame, tile: float, left_key: str, right_key: str) -> DataFrame:
    """Pieces of the pairs (_left, _right) of shapes that meet in a tile.

    Both are cut at tiles first, so a large shape is met piece by piece: no pair holds more of it than a tile."""
    cut = lambda df, key, side: in_tiles(df.select(F.col(key).alias("gid"), F.lit(side).alias("side"), "rings"), [], tile, None)
    a, b = cut(left, left_key, 0), cut(right, right_key, 1)
    pairs = a.select(F.col("gid").alias("_left"), "size", "tx", "ty", F.col("rings").alias("ra")).join(b.select(F.col("gid").alias("_right"), "tx", "ty", F.col("rings").alias("rb")), ["tx", "ty"])
    pairs = pairs.withColumns({"_a": G.bounds(F.col("ra")), "_b": G.bounds(F.col("rb"))}).where("_a.minx < _b.maxx and _b.minx < _a.maxx and _a.miny < _b.maxy and _b.miny < _a.maxy")
    rows = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ra").alias("rings")), F.struct(F.lit(1).alias("side"), F.col("rb").alias("rings"))))
    pieces = pairs.select("_left", "_right", "size", "tx", "ty", F.col("tx").alias("base_x"), F.col("ty").alias("base_y"), F.lit(0).alias("gid"), rows.alias("r"))
    return pieces.select(*(c for c in pieces.columns if c != "r"), "r.*")


def shared_area(left: DataFrame, right: DataFrame, tile: float, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, area) for the pairs of shapes that share area. Both tables: (key, rings), a row for each key."""
    pieces = _met(left, right, tile, left_key, right_key)
    areas = _areas(pieces, ["_left", "_right"], "intersection", alone=True)
    return areas.where("area > 0").toDF(left_key, right_key, "area")


def clipped(left: DataFrame, right: DataFrame, tile: float, left_key: str, right_key: str, least_m2: float = 1e-6) -> DataFrame:
    """(left_key, right_key, area, rings) for the same pairs: what of each left shape lies in each right one, as rings.

    Outer rings come first; a shape that falls apart has several. Pairs that share less than ``least_m2`` have no row."""
    rings = _rings(_met(left, right, tile, left_key, right_key), ["_left", "_right"], "intersection", least_m2, alone=True)
    ordered = F.array_sort(F.collect_list(F.struct("hole", "ring_id", "ring")))
    out = rings.groupBy("_left", "_right").agg(F.sum("area").alias("area"), F.transform(ordered, lambda r: r["ring"]).alias("rings"))
    return out.toDF(left_key, right_key, "area", "rings")


def coverage(footprints: DataFrame, zones: DataFrame, key: str, tile: float) -> DataFrame:
    """(key, percent, missing_m2) of each zone (key, rings): how much of it the union of the footprints (rings) covers.

    Footprints and zones meet tile by tile. A zone without a footprint has 0; one without area has no row."""
    cut = lambda df, side, own: in_tiles(df.select(*own, F.monotonically_increasing_id().alias("gid"), F.lit(side).alias("side"), "rings"), ["_zone"] if side else [], tile, None)
    z = written(cut(zones, 1, [F.col(key).alias("_zone")]), "zones")
    prints = cut(footprints, 0, []).join(z.select("tx", "ty", "_zone").distinct(), ["tx", "ty"]).select(*z.columns)
    area = lambda rule, pieces: _areas(pieces, ["_zone"], rule)
    whole = area("union", z.withColumn("side", F.lit(0))).withColumnRenamed("area", "whole")
    out = whole.join(area("intersection", prints.unionByName(z)), "_zone", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("area") / F.col("whole") * 100))
    return out.select(F.col("_zone").alias(key), percent.alias("percent"), F.greatest(F.col("whole") - F.col("area"), F.lit(0.0)).alias("missing_m2"))
