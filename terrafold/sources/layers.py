"""Writing shapefile layers: hidden files first, then all layers are put in place at once, or none.

A layer is one file and has one order, so a task writes it as a stream of records. Files are written beside their
target under a hidden name; when all tasks are done, counts are checked, the old families are set aside, the new ones
take their names, and only then the old ones go. Any failure before that puts everything back. The folder is one that
driver and executors share (a mounted store)."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from terrafold.sources.shapefile import BadLayer, records

# The files of a layer, and the indexes that are stale once it changes.
FAMILY, STALE = (".shp", ".shx", ".dbf", ".prj", ".cpg"), (".qix", ".sbn", ".sbx")
OWN = ("layer", "feature_no", "rings")


def inside(folder: Path, name: str) -> Path:
    """The path of a layer in the folder; names that lead out of it are refused."""
    target = (folder / name).resolve()
    if not target.is_relative_to(folder.resolve()):
        raise ValueError(f"{name} lies outside of {folder}")
    return target if target.suffix.lower() == ".shp" else target.with_name(target.name + ".shp")


def family(shp: Path) -> list[Path]:
    """The files that belong to a layer, whatever the case of their suffix."""
    if not shp.parent.is_dir():
        return []
    known = FAMILY + STALE
    return sorted(p for p in shp.parent.iterdir() if p.name[: len(shp.stem)] == shp.stem and p.name[len(shp.stem) :].lower() in known)


def _field(name: str, kind: DataType) -> tuple[bytes, bytes, int, int]:
    """(name, type, width, decimals) of a column in a .dbf."""
    if isinstance(kind, (LongType, IntegerType, ShortType)):
        return name.encode()[:10], b"N", 18, 0
    if isinstance(kind, (DoubleType, FloatType)):
        return name.encode()[:10], b"N", 24, 15
    if isinstance(kind, BooleanType):
        return name.encode()[:10], b"L", 1, 0
    return name.encode()[:10], b"C", 254, 0


def _cell(value, kind: bytes, width: int, decimals: int) -> bytes:
    if value is None:
        return b" " * width
    if kind == b"L":
        return b"T" if value else b"F"
    if kind == b"N":
        text = f"{value:.{decimals}f}" if decimals else str(value)
        if len(text) > width:  # fewer decimals, or a power of ten
            text = f"{value:.{max(0, width - 8)}e}"
        return text[:width].rjust(width).encode()
    raw = str(value).encode()[:width]
    return raw.decode("utf-8", "ignore").encode().ljust(width)  # not within a letter


def dbf_head(fields: list[tuple[bytes, bytes, int, int]], count: int) -> bytes:
    head = struct.pack("<B3BIHH20x", 3, 124, 1, 1, count, 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    return head + b"".join(n.ljust(11, b"\0") + k + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in fields) + b"\r"


def directed(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings as the format wants them: outer ones clockwise, holes (within an odd number of others) the other way."""
    out = []
    for k, r in enumerate(rings):
        x, y = r[:, 0], r[:, 1]
        area = float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())
        px, py = (r[0] + r[1]) / 2
        around = 0
        for j, o in enumerate(rings):
            if j != k:
                (ax, ay), (bx, by) = o[:-1].T, o[1:].T
                up = (ay > py) != (by > py)
                with np.errstate(divide="ignore", invalid="ignore"):
                    around += int((up & (px < (bx - ax) * (py - ay) / (by - ay) + ax)).sum() % 2)
        out.append(r[::-1] if (area > 0) == (around % 2 == 0) else r)
    return out


def record(rings: list | None) -> tuple[bytes, np.ndarray | None]:
    """The body of a polygon record and its box; a null shape without rings of 3 points."""
    parts = [np.array([(p["x"], p["y"]) for p in r], float) for r in rings or [] if r and len(r) > 2]
    parts = [r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]) for r in parts]
    if not parts:
        return struct.pack("<i", 0), None
    parts = directed(parts)
    xy = np.concatenate(parts)
    box = np.concatenate([xy.min(axis=0), xy.max(axis=0)])
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype("<i4")
    return struct.pack("<i4dii", 5, *box, len(parts), len(xy)) + starts.tobytes() + xy.astype("<f8").tobytes(), box


class LayerFile:
    """One layer that is being written, record by record."""

    def __init__(self, shp: Path, fields: list[tuple[bytes, bytes, int, int]], crs: str | None) -> None:
        shp.parent.mkdir(parents=True, exist_ok=True)
        self.fields, self.count, self.at, self.box = fields, 0, 50, np.array([np.inf, np.inf, -np.inf, -np.inf])
        self.shp, self.shx, self.dbf = (shp.with_suffix(s).open("wb") for s in FAMILY[:3])
        for f in (self.shp, self.shx):
            f.write(bytes(100))
        self.dbf.write(dbf_head(fields, 0))
        shp.with_suffix(".cpg").write_text("UTF-8")
        if crs:
            shp.with_suffix(".prj").write_text(crs)

    def add(self, rings: list | None, values: list) -> None:
        body, box = record(rings)
        self.count += 1
        if box is not None:
            self.box = np.concatenate([np.minimum(self.box[:2], box[:2]), np.maximum(self.box[2:], box[2:])])
        self.shp.write(struct.pack(">ii", self.count, len(body) // 2) + body)
        self.shx.write(struct.pack(">ii", self.at, len(body) // 2))
        self.at += 4 + len(body) // 2
        self.dbf.write(b" " + b"".join(_cell(v, *f[1:]) for v, f in zip(values, self.fields, strict=True)))

    def close(self) -> int:
        box = self.box if self.box[0] <= self.box[2] else np.zeros(4)
        for f, words in ((self.shp, self.at), (self.shx, 50 + 4 * self.count)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i4d", 1000, 5, *box) + bytes(32))
        self.dbf.write(b"\x1a")
        self.dbf.seek(0)
        self.dbf.write(dbf_head(self.fields, self.count))
        for f in (self.shp, self.shx, self.dbf):
            f.close()
        return self.count


@dataclass
class Staged(WriterCommitMessage):
    """(hidden .shp, target .shp, records) of the layers that a task wrote."""

    layers: list[tuple[str, str, int]]


def counted(shp: Path) -> int:
    """Records of a layer by its index and its table, which must agree."""
    by_index = (shp.with_suffix(".shx").stat().st_size - 100) // 8
    with shp.with_suffix(".dbf").open("rb") as f:
        by_table = struct.unpack("<I", f.read(8)[4:])[0]
    if by_index != by_table:
        raise BadLayer(f"{shp.name}: {by_index} shapes, but {by_table} rows")
    return by_index


def put_in_place(staged: list[tuple[str, str, int]], token: str, overwrite: bool) -> None:
    """All layers take their names, or none does."""
    targets = [t for _, t, _ in staged]
    if len(set(targets)) < len(targets):
        raise ValueError("a layer was written by two tasks: deal rows out by layer")
    for hidden, target, count in staged:
        if counted(Path(hidden)) != count:
            raise BadLayer(f"{target}: {counted(Path(hidden))} records instead of {count}")
        if not overwrite and family(Path(target)):
            raise FileExistsError(f"{target} is there already")
    aside: list[tuple[Path, Path]] = []
    placed: list[Path] = []
    try:
        for _, target, _ in staged:
            for old in family(Path(target)):
                backup = old.with_name(f".{old.name}.{token}.backup")
                old.rename(backup)
                aside.append((old, backup))
        for hidden, target, count in staged:
            for new in family(Path(hidden)):
                to = Path(target).with_name(Path(target).stem + new.name[len(Path(hidden).stem) :])
                new.rename(to)
                placed.append(to)
            if counted(Path(target)) != count:
                raise BadLayer(f"{target}: records were lost")
    except BaseException:
        for p in placed:
            p.unlink(missing_ok=True)
        for old, backup in reversed(aside):
            backup.rename(old)
        raise
    for _, backup in aside:  # stale indexes go with the old files
        backup.unlink(missing_ok=True)


class LayerWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.crs = Path(options["path"]), options.get("crs")
        self.overwrite, self.some = options.get("replace") == "true", options.get("some") == "true"
        self.token = uuid.uuid4().hex
        self.names = [f.name for f in schema if f.name not in OWN]
        self.fields = [_field(f.name, f.dataType) for f in schema if f.name not in OWN]

    def write(self, iterator: Iterator[Row]) -> Staged:
        """One layer is open at a time: rows come sorted by layer."""
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        done: list[tuple[str, str, int]] = []
        name, file, hidden, target = None, None, None, None
        for row in iterator:
            if row["layer"] != name or file is None:
                if file is not None:
                    done.append((str(hidden), str(target), file.close()))
                name = row["layer"]
                target = inside(self.folder, name)
                hidden = target.with_name(f".{target.stem}.{self.token}-{attempt}-building.shp")
                file = LayerFile(hidden, self.fields, self.crs)
            file.add(row["rings"], [row[n] for n in self.names])
        if file is not None:
            done.append((str(hidden), str(target), file.close()))
        return Staged(done)

    def _tidy(self) -> None:
        """Hidden files of this run that no layer took: of failed or repeated attempts."""
        if self.folder.is_dir():
            for p in self.folder.rglob(f".*.{self.token}-*-building.*"):
                p.unlink(missing_ok=True)

    def commit(self, messages: list) -> None:
        staged = [x for m in messages if m is not None for x in m.layers]
        try:
            if self.some and not staged:
                raise ValueError("there is nothing to write")
            put_in_place(staged, self.token, self.overwrite)
        finally:
            self._tidy()

    def abort(self, messages: list) -> None:
        self._tidy()


class LayerSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polygon_layers"

    def writer(self, schema: StructType, overwrite: bool) -> LayerWriter:
        return LayerWriter(dict(self.options), schema)


def write_layers(rows: DataFrame, folder: str, crs: str | None = None, overwrite: bool = False, some: bool = False) -> None:
    """Writes polygon layers from rows (layer, feature_no, rings, attribute columns), each in the order of feature_no.

    ``layer`` is a path below the folder. Numbers, truth values and texts (cut at 254 bytes) become columns of those
    kinds; names are cut at 10 bytes. Without ``overwrite`` a layer that is there already is an error; with ``some``
    so is an empty table. An error leaves all layers as they were."""
    rows.sparkSession.dataSource.register(LayerSink)
    dealt = rows.repartition("layer").sortWithinPartitions("layer", "feature_no")
    writer = dealt.write.format("polygon_layers").option("replace", str(overwrite).lower()).option("some", str(some).lower())
    (writer.option("crs", crs) if crs else writer).mode("append").save(folder)


def class_field(names: list[str]) -> str:
    """The first column named class in any case, else ``class``."""
    return next((n for n in names if n.lower() == "class"), "class")


def with_class(dbf: bytes, value: int) -> bytes:
    """A table whose class column is one whole number in all rows; other columns are kept byte by byte."""
    count, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields = [(dbf[a : a + 11], dbf[a + 16], dbf[a : a + 32]) for a in range(32, head - 1, 32)]
    own = class_field([n.split(b"\0")[0].decode("latin-1") for n, _, _ in fields])
    column = own.encode("latin-1").ljust(11, b"\0") + b"N" + bytes(4) + bytes([18, 0]) + bytes(14)
    spans, at = [], 1
    for name, size, raw in fields:
        mine = name.split(b"\0")[0].decode("latin-1") == own
        spans.append((at, at + size, mine, column if mine else raw))
        at += size
    if not any(m for *_, m, _ in spans):
        spans.append((at, at, True, column))
    new = bytearray(dbf[:32]) + b"".join(raw for *_, raw in spans) + b"\r"
    cell = str(value).rjust(18).encode()
    size = 1 + sum(18 if m else b - a for a, b, m, _ in spans)
    struct.pack_into("<HH", new, 8, len(new), size)
    for k in range(count):
        row = dbf[head + k * width : head + (k + 1) * width]
        new += row[:1] + b"".join(cell if m else row[a:b] for a, b, m, _ in spans)
    return bytes(new) + b"\x1a"


class RewriteWriter(LayerWriter):
    """Layers as whole files: rows (layer, suffix, content)."""

    def write(self, iterator: Iterator[Row]) -> Staged:
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        done: dict[str, tuple[str, str, int]] = {}
        for row in iterator:
            target = inside(self.folder, row["layer"])
            hidden = target.with_name(f".{target.stem}.{self.token}-{attempt}-building.shp")
            hidden.parent.mkdir(parents=True, exist_ok=True)
            hidden.with_suffix(row["suffix"].lower()).write_bytes(row["content"])
            _, _, n = done.get(row["layer"], (None, None, 0))
            if row["suffix"].lower() == ".shp":
                n = sum(1 for _ in records(row["content"]))
            done[row["layer"]] = (str(hidden), str(target), n)
        return Staged(list(done.values()))


class RewriteSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layer_files"

    def writer(self, schema: StructType, overwrite: bool) -> LayerWriter:
        return RewriteWriter(dict(self.options), schema)


def rewrite_class(spark: SparkSession, source: str, target: str, value: int, overwrite: bool = False) -> None:
    """Copies all layers below a folder with their class column set to one number; folders and other columns are kept.

    ``target`` may be ``source`` (with ``overwrite``): the old files go only when all new ones are complete, and
    spatial indexes are dropped. A layer whose files are cut short, or whose counts differ, fails all."""
    base = Path(source).resolve()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(base))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    stem = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\.[^./]+$", "")

    @F.pandas_udf("binary")
    def changed(content, suffix):
        return content.where(suffix != ".dbf", content.map(lambda b: b"" if len(b) < 33 else with_class(b, value)))

    rows = files.select(F.substring(stem, len(str(base)) + 2, 1 << 20).alias("layer"), suffix.alias("suffix"), "content").where(F.col("suffix").isin(*FAMILY) & ~F.element_at(F.split("layer", "/"), -1).startswith("."))
    rows = rows.withColumn("layer", F.concat("layer", F.lit(".shp"))).withColumn("content", changed("content", "suffix"))
    spark.dataSource.register(RewriteSink)
    rows.repartition("layer").sortWithinPartitions("layer").write.format("layer_files").option("replace", str(overwrite).lower()).mode("append").save(target)
