"""Names, codes, paths and their formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of region names, pattern of a full product name, of a short tile name, of a merged name.
REGION_SUFFIX = "(市|盟|地区|自治州)$"
PRODUCT = r"(?i)^(S2[ABC])_(MSIL[12][AC])_(\d{8}T\d{6})_(N\d{4})_(R\d{3})_(T\d{2}[A-Z]{3})_(\d{8}T\d{6})"
PRODUCT_FIELDS = ("satellite", "level", "sensing", "baseline", "orbit", "tile", "generation")
TILE_TIME = r"(?i)^(T\d{2}[A-Z]{3})_(\d{8}T\d{6})\.tif{1,2}$"
TOWN = "^(.+?(镇|乡|苏木|街道))边界(\\.|$)"


def region_name(c: Column) -> Column:
    """Trimmed, without one suffix."""
    return F.regexp_replace(F.trim(c), REGION_SUFFIX, "")


def numeric_code(c: Column, digits: int) -> Column:
    """Digits of a code that may have been read as a number, the first ``digits`` of them; empty if there are fewer."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", ""), r"\D", "")
    return F.when(F.length(plain) >= digits, F.substring(plain, 1, digits)).otherwise("")


def safe_name(c: Column, default: str = "UNKNOWN") -> Column:
    """Without characters that file systems refuse, and without dots and spaces at the ends."""
    clean = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(default))


def mounted(c: Column, shares: dict[str, str]) -> Column:
    """A share path (backslashes or slashes, any case) under its mount; other paths as they are."""
    slashed = F.translate(c, "\\", "/")
    out = c
    for share, mount in shares.items():
        prefix = share.replace("\\", "/").rstrip("/")
        here = (F.lower(F.substring(slashed, 1, len(prefix))) == prefix.lower()) & (F.length(slashed) == len(prefix)) | F.lower(slashed).startswith(prefix.lower() + "/")
        out = F.when(here, F.concat(F.lit(mount.rstrip("/")), F.substring(slashed, F.lit(len(prefix) + 1), F.length(slashed)))).otherwise(out)
    return out


def shared(c: Column, mount: str, share: str) -> Column:
    """The inverse: a path under the mount as a share path with backslashes."""
    return F.when(c.startswith(mount.rstrip("/") + "/"), F.concat(F.lit(share.rstrip("\\")), F.translate(F.substring(c, F.lit(len(mount.rstrip("/")) + 1), F.length(c)), "/", "\\"))).otherwise(c)


def product(c: Column) -> Column:
    """struct of the fields of a full product name; each null when the name isn't one."""
    matched = c.rlike(PRODUCT)
    return F.struct(*(F.when(matched, F.regexp_extract(c, PRODUCT, k)).alias(n) for k, n in enumerate(PRODUCT_FIELDS, 1)))


def sensing_time(c: Column) -> Column:
    return F.to_timestamp_ntz(c, F.lit("yyyyMMdd'T'HHmmss"))


def without_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.SAFE(\.zip)?$", "")


def stem(c: Column) -> Column:
    """Last part of a path in either slash style, without its extension."""
    return F.regexp_replace(F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1), r"\.[^.]+$", "")


def extension(c: Column) -> Column:
    return F.when(F.lower(c).endswith(".shp.xml"), ".shp.xml").otherwise(F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1)))


def byte_size(c: Column) -> Column:
    """As B, KB, MB, GB or TB with two decimals, ties to the even one (whole bytes)."""
    out = F.concat(c.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024**k, F.concat(F.format_string("%.2f", F.bround(c / float(1024**k), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def elapsed(c: Column) -> Column:
    """Seconds as 1h02m03s, 2m03s or 3s; half seconds go to the even one."""
    s = F.bround(c, 0).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def compact_date(c: Column) -> Column:
    """yyyymmdd of a date with or without hyphens; null if there aren't eight digits."""
    plain = F.regexp_replace(c, "-", "")
    return F.when(plain.rlike(r"^\d{8}$"), plain)


def log_level(c: Column) -> Column:
    return F.when(c.contains("ERROR") | c.contains("错误") | c.contains("失败"), "error").otherwise("info")


def town(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, TOWN, 1), F.lit(""))


def split_list(c: Column) -> Column:
    return F.filter(F.split(c, "[,，\\s]+"), lambda x: x != "")


def without_escapes(c: Column) -> Column:
    return F.regexp_replace(c, "\\x1B\\[[0-9;?]*[A-Za-z]", "")


def grid_id(row: Column, col: Column) -> Column:
    return F.format_string("R%05dC%05d", row, col)


def plain_name(c: Column, default: str = "CITY") -> Column:
    """Only letters, digits, hyphens and underscores; runs of others are one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def single_spaced(c: Column) -> Column:
    """Trimmed, with an underscore for each run of white space."""
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def county_file(code: Column, date: Column, scene: Column, satellite: Column, resolution: Column) -> Column:
    return F.format_string("CQDOM%s_%s_%s_%s_%s.tif", code, date, scene, satellite, resolution)


def city_file(code: Column, sensing: Column) -> Column:
    return F.format_string("%s_%s.tif", code, sensing)


def with_suffix(name: Column, suffix: str) -> Column:
    """A file name with its last suffix replaced, or with the suffix if it has none."""
    return F.concat(F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", ""), F.lit(suffix))


def _last_part(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), r"^.*[/\\]", "")), F.lit(""))


def result_name(c: Column, fallback: Column, suffix: str) -> Column:
    """The last part of a wanted name, or the fallback, with the suffix in place of its own."""
    return with_suffix(F.coalesce(_last_part(c), fallback), suffix)


def result_names(shp: Column, tif: Column) -> Column:
    """struct(shp, tif, error) of two wanted names: a missing one takes the other's stem; without any there is an error."""
    one, two = _last_part(F.coalesce(shp, F.lit(""))), _last_part(F.coalesce(tif, F.lit("")))
    names = F.struct(with_suffix(F.coalesce(one, two), ".shp").alias("shp"), with_suffix(F.coalesce(two, one), ".tif").alias("tif"))
    return F.struct(names["shp"].alias("shp"), names["tif"].alias("tif"), F.when(names["shp"].isNull(), "no name").alias("error"))


def log_path(root: str, created_at: Column) -> Column:
    """A file for each day; 'unknown' where the time has no date."""
    day = F.substring(created_at, 1, 10)
    return F.concat(F.lit(f"{root}/"), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise("unknown"), F.lit(".log"))


def box_name(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The numbers of a box as a file name: p for a point, m for a minus."""
    return F.translate(F.concat_ws("_", *(c.cast("string") for c in (minx, miny, maxx, maxy))), ".-", "pm")


def valid_range(start: Column, end: Column) -> Column:
    """Both have the form yyyy-mm-dd, and the start isn't after the end; days that no month has are taken as they are."""
    form = r"^\d{4}-\d{2}-\d{2}$"
    return F.coalesce(start.rlike(form) & end.rlike(form) & (start <= end), F.lit(False))


def hidden(c: Column) -> Column:
    """Hidden or temporary files."""
    return c.startswith(".") | F.lower(c).contains(".tmp.")
