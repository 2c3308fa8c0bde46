"""Row rules over layers, names, catalogues and logs: which field names a region, which rows stay, what is asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.names import region_name
from terrafold.operators.ranges import written

# Fields that may name a region of interest, in order; names of collections; town endings.
ROI_FIELDS = ("area_name", "name", "Name", "NAME", "名称", "市名称", "县名称", "区名称", "旗名称", "盟名称", "省名称")
COLLECTIONS = {"sentinel-1": ("SENTINEL-1", ""), "sentinel-1-grd": ("SENTINEL-1", "GRD"), "sentinel-1-slc": ("SENTINEL-1", "SLC"), "sentinel-2": ("SENTINEL-2", ""), "sentinel-2-l1c": ("SENTINEL-2", "L1C"), "sentinel-2-l2a": ("SENTINEL-2", "L2A")}
TOWN = r"(镇|乡|苏木|街道)$"
WARNING = 30


def said(c: Column) -> Column:
    """The text of a value, trimmed; null if there is none, or if it says 'none'."""
    text = F.trim(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "none"), text)


def name_field(rows: DataFrame, candidates: Sequence[str], requested: str | None = None, without: Sequence[str] = ("geometry", "rings")) -> str | None:
    """The column that names the rows: the requested one, else the first candidate with any value, else the first column with any.

    One pass counts the values of all columns. A requested column that isn't there is an error."""
    if requested:
        if requested not in rows.columns:
            raise ValueError(f"there is no field {requested}, only {', '.join(rows.columns)}")
        return requested
    names = [c for c in rows.columns if c not in without]
    if not names:
        return None
    filled = rows.agg(*(F.count(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))).first()
    have = {c for k, c in enumerate(names) if filled[k]}
    return next((c for c in [*candidates, *names] if c in have), None)


def row_names(rows: DataFrame, field: str | None, number: str) -> Column:
    """A row's name: of the field, else its source file, else region_001 and so on by ``number`` (from 0)."""
    own = said(F.col(field)) if field else F.lit(None).cast("string")
    source = F.nullif(F.trim(F.coalesce("_source_file", F.lit(""))), F.lit("")) if "_source_file" in rows.columns else F.lit(None).cast("string")
    return F.coalesce(own, source, F.format_string("region_%03d", F.col(number) + 1))


def roi_name(rows: DataFrame, stem: Column | str, order: str) -> DataFrame:
    """One row (name): the first value of the first of ROI_FIELDS that has any, made safe for files, else the stem."""
    from terrafold.functions.names import single_spaced

    fields = [f for f in ROI_FIELDS if f in rows.columns]
    first = [F.min_by(said(F.col(f)), F.when(said(F.col(f)).isNotNull(), F.col(order))).alias(f"f{k}") for k, f in enumerate(fields)]
    stem = F.lit(stem) if isinstance(stem, str) else stem
    found = F.coalesce(*(F.col(f"f{k}") for k in range(len(fields))), stem) if fields else stem
    told = rows.agg(*first) if fields else rows.agg(F.count("*").alias("n"))
    return told.select(single_spaced(F.regexp_replace(found, r'[\\/:*?"<>|]+', "_")).alias("name"))


def kept_scenes(scenes: DataFrame, dates: Sequence[str] = (), satellites: Sequence[str] = (), tiles: Sequence[str] = ()) -> DataFrame:
    """Scenes (day, satellite, tile) of the wanted days, satellites and tiles; an empty list wants all."""
    for column, wanted in (("day", [d.replace("-", "") for d in dates]), ("satellite", [s.upper() for s in satellites]), ("tile", [t.upper() for t in tiles])):
        if wanted:
            scenes = scenes.where(F.upper(column).isin(wanted))
    return scenes


def kept_cities(cities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cities (city_name) whose name, without its ending, is among the wanted names (name)."""
    names = wanted.select(region_name(F.col("name")).alias("_n")).where("_n != ''").distinct()
    return cities.withColumn("_n", region_name(F.col("city_name"))).join(names, "_n", "left_semi").drop("_n")


def kept_counties(counties: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counties (county_name, county_code) whose name or code is among the wanted words (name)."""
    words = wanted.select(F.trim("name").alias("_w")).distinct()
    keyed = counties.withColumn("_w", F.explode(F.array_distinct(F.array("county_name", "county_code"))))
    return keyed.join(words, "_w", "left_semi").drop("_w").dropDuplicates()


def product_level(name: Column, level: str = "_MSIL2A_") -> Column:
    """The reason why a product is not of the level; null if it is."""
    return F.when(~F.upper(name).contains(level), F.format_string("no %s product: %s", F.lit(level.strip("_")), name))


def collection(name: Column) -> Column:
    """struct(collection, contains) that a catalogue is asked for."""
    known = F.create_map(*(x for k, (c, word) in COLLECTIONS.items() for x in (F.lit(k), F.struct(F.lit(c).alias("collection"), F.lit(word).alias("contains")))))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.struct(F.upper(name).alias("collection"), F.lit("").alias("contains")))


def catalogue_filter(name: Column, wkt: Column, cloud: Column, start: Column, end: Column, contains: Column | None = None) -> Column:
    """The filter text of a catalogue query: name, collection, area, cloud cover (of the second mission only) and days, both included."""
    own = collection(name)
    word = F.nullif(F.coalesce(contains, own["contains"]) if contains is not None else own["contains"], F.lit(""))
    parts = [
        F.when(word.isNotNull(), F.concat(F.lit("contains(Name,'"), word, F.lit("')"))),
        F.concat(F.lit("Collection/Name eq '"), own["collection"], F.lit("'")),
        F.when(wkt.isNotNull(), F.concat(F.lit("OData.CSC.Intersects(area=geography'SRID=4326;"), wkt, F.lit("')"))),
        F.when((own["collection"] == "SENTINEL-2") & cloud.isNotNull(), F.concat(F.lit("Attributes/OData.CSC.DoubleAttribute/any(att:att/Name eq 'cloudCover' and att/OData.CSC.DoubleAttribute/Value le "), cloud.cast("string"), F.lit(")"))),
        F.concat(F.lit("ContentDate/Start ge "), start, F.lit("T00:00:00.000Z and ContentDate/Start le "), end, F.lit("T23:59:59.999Z")),
    ]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), " and ")


def answers(products: DataFrame, name: str, contains: str | None = None, cloud: float | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Products (name, collection, cloud, start) that such a query would give, from a table of them: the same rules as rows.

    A product without a cloud cover fails a query that names one."""
    own, word = COLLECTIONS.get(name.lower(), (name.upper(), ""))
    word = contains if contains is not None else word
    keep = (F.col("collection") == own) & (F.col("name").contains(word) if word else F.lit(True))
    if cloud is not None and own == "SENTINEL-2":
        keep &= F.coalesce(F.col("cloud") <= cloud, F.lit(False))
    if start:
        keep &= F.col("start") >= F.to_timestamp(F.lit(start))
    if end:
        keep &= F.col("start") < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY")
    return products.where(keep)


def loose_files(files: DataFrame, root: str) -> DataFrame:
    """Files (path) below the root that lie in a folder, none of which is a town's: neither at the root nor in a sorted place."""
    base = root.rstrip("/") + "/"
    inner = F.substring("path", len(base) + 1, 1 << 20)
    folders = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    return files.where(F.col("path").startswith(base) & (F.size(folders) > 0) & ~F.exists(folders, lambda p: p.rlike(TOWN)))


def within(path: Column, folder: Column | str) -> Column:
    """Whether a path, once its '.' and '..' are gone, lies in the folder (or is it)."""
    folder = F.lit(folder) if isinstance(folder, str) else folder

    def plain(p: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(p, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
        step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))

    mine, base = plain(path), plain(folder)
    return (mine == base) | mine.startswith(F.when(base == "/", "/").otherwise(F.concat(base, F.lit("/"))))


def routed(events: DataFrame, main: str) -> DataFrame:
    """Log rows (logger, level, final) that go to the short file: of the main logger, final ones, and from warnings up."""
    return events.where((F.col("logger") == main) | F.coalesce("final", F.lit(False)) | (F.col("level") >= WARNING))


def checked_configs(configs: DataFrame, cities: DataFrame) -> DataFrame:
    """Configurations (id, input, output, workers: text, cities: array) with their first ``error``, null if there is none.

    Input and output must be said, workers be a whole number from 1 to 32, and cities be some of the known (city_name)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    workers = F.trim("workers").try_cast("int")
    wanted = configs.select("id", F.explode("cities").alias("city_name"))
    unknown = wanted.join(cities.select("city_name").distinct(), "city_name", "left_anti").groupBy("id").agg(F.min("city_name").alias("_unknown"))
    error = F.when(blank("input"), "input is empty").when(blank("output"), "output is empty").when(workers.isNull(), "workers is no whole number").when(~workers.between(1, 32), "workers is not from 1 to 32")
    error = error.when(F.size(F.coalesce("cities", F.array().cast("array<string>"))) == 0, "no city").when(F.col("_unknown").isNotNull(), F.concat(F.lit("unknown city "), "_unknown"))
    return configs.join(unknown, "id", "left").withColumn("error", error).drop("_unknown")


def planned_workers(requested: Column, accounts: Column, each: int = 3) -> Column:
    """struct(planned, clients, last): workers that the accounts allow, how many accounts they need, and the last one's share."""
    planned = F.least(F.greatest(requested, F.lit(1)), accounts * each)
    clients = F.ceil(planned / each)
    return F.struct(planned.cast("int").alias("planned"), clients.cast("int").alias("clients"), (planned - (clients - 1) * each).cast("int").alias("last"))


def rejected(archives: DataFrame, source: str, target: str) -> DataFrame:
    """(path, reason, destination, side, side_destination): where skipped archives (path, reason, has_txt) go, with their text.

    The place below ``source`` is kept below ``target``; what lies elsewhere goes to the top. Names that meet are
    numbered in the order of the paths. The plan is for a run that has succeeded as a whole."""
    from terrafold.operators.manifest import unique_names

    base = source.rstrip("/") + "/"
    relative = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 20)).otherwise(F.element_at(F.split("path", "/"), -1))
    placed = archives.where("reason is not null").withColumn("name", relative)
    named = unique_names(placed.select("path", "name")).select("path", F.concat(F.lit(target.rstrip("/") + "/"), "target").alias("destination"))
    text = lambda c: F.regexp_replace(c, r"\.[^./]+$", ".txt")
    out = placed.select("path", "reason", "has_txt").join(named, "path")
    side = lambda c: F.when(F.col("has_txt"), text(F.col(c)))
    return out.select("path", "reason", "destination", side("path").alias("side"), side("destination").alias("side_destination"))


def fanned_out(archives: DataFrame, existing: DataFrame) -> DataFrame:
    """(archive, city, action, source): how each archive (archive, cities: array) comes to each of its cities.

    'existing' where the city has a valid copy (archive, city, valid); else 'copy' from the first city that has one, else
    'extract' for the first city of the archive and 'copy' from there for the others. Cities count once; nothing is extracted twice."""
    wanted = archives.select("archive", F.explode(F.array_distinct("cities")).alias("city"))
    have = existing.where("valid").select("archive", "city").distinct().withColumn("there", F.lit(True))
    first = have.groupBy("archive").agg(F.min("city").alias("donor")).join(wanted.groupBy("archive").agg(F.min("city").alias("least")), "archive", "right")
    out = wanted.join(have, ["archive", "city"], "left").join(first, "archive")
    action = F.when(F.col("there"), "existing").when(F.col("donor").isNull() & (F.col("city") == F.col("least")), "extract").otherwise("copy")
    return out.withColumn("action", action).select("archive", "city", "action", F.when(F.col("action") == "copy", F.coalesce("donor", "least")).alias("source"))


def in_rounds(items: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], most: int = 100) -> DataFrame:
    """(key, round): items tried again, round by round, until none has failed; ``attempt(open, round)`` gives (key, ok).

    Each round's answers are written once, so an attempt isn't made twice. Items that still fail after ``most`` rounds have a null round."""
    left = written(items.select(key).distinct(), "open")
    done = []
    for n in range(1, most + 1):
        if not left.limit(1).count():
            break
        tried = written(attempt(left, n).select(key, "ok"), "tried")
        good = tried.where("ok").select(key).distinct()
        done.append(good.join(left, key, "left_semi").withColumn("round", F.lit(n)))
        left = written(left.join(good, key, "left_anti"), "open")
    out = left.withColumn("round", F.lit(None).cast("int"))
    for d in done:
        out = out.unionByName(d)
    return out


def whole_or_nothing(files: DataFrame) -> DataFrame:
    """One row (total_m2, files, failed): the total is null if any file (area_m2, error) failed."""
    failed = F.count_if(F.col("error").isNotNull())
    return files.agg(F.when(failed == 0, F.coalesce(F.sum("area_m2"), F.lit(0.0))).alias("total_m2"), F.count("*").alias("files"), failed.alias("failed"))


def fingerprint(files: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) with a ``fingerprint`` that changes with size or time, to the millisecond."""
    return files.withColumn("fingerprint", F.concat_ws(":", "length", F.unix_millis("modificationTime")))
