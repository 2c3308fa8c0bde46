"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame functions only.

Base spans are regular-expression matches. The corpus then says how strongly a term reveals a protected
entity (a base match): a term that is in several documents with the same entity, and hardly anywhere else in
the corpus, discloses it and becomes a span wherever it stands. Sanitised texts have base spans
generalised to their kind and disclosing terms removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The kinds in their order, and their patterns. The patterns match what the plain ones do, but take
# runs whole and enter a run in its middle only where the last match ended, so no text makes them slow or deep.
KINDS = ("email", "ip", "card", "phone")
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SLOTS = 1 << 20
MASK = "\ue000"  # stands for each code point of a base span
TERM = rf"[\p{{L}}\p{{N}}{MASK}]{{3,}}+"
BLOCK = 256
CHUNK = 64
_ONE = "struct<kind:string,start:int,end:int,match:string>"
_SPAN = f"array<{_ONE}>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    from_right = F.split(F.reverse(_digits(m)), "(?<=.)(?=.)")
    each = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


#: What a match must pass, and a cheap test that a text has any match.
PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255),
    "card": lambda m: F.when(_between(F.length(_digits(m)), 13, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: _between(F.length(_digits(m)), 9, 15),
}
GATE: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scanned(xs: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` puts out for each of ``xs``, from an int that it passes on: step(at, x) is a struct of at and out (of ``kind``).

    Results are gathered in blocks, so that the work stays in proportion to the array."""

    def block(at: Column, part: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, begin, lambda a, x: _let(step(a["at"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))))

    def run(all_: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        more = lambda a, b: _let(block(a["at"], F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(blocks, begin, more, lambda a: a["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(xs, run)


def _matches(text: Column, pattern: str, kind: str, passes: Callable[[Column], Column]) -> Column:
    """Leftmost matches that pass, with their places in code points, from the lengths of the matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = _let(found, lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))))

    def step(at: Column, x: Column) -> Column:
        start = at + x["b"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("match")).alias("out"))

    return F.filter(_scanned(pieces, _ONE, step), lambda s: passes(s["match"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text: by kind as listed, then by start."""
    none = F.array().cast(_SPAN)
    return F.concat(*(F.when(GATE[k](text), _matches(text, PATTERN[k], k, PASSES[k])).otherwise(none) for k in KINDS))


def _terms(masked: Column) -> Column:
    """The different terms of a text, but for those that reach into a base span."""
    return F.array_distinct(F.transform(F.filter(F.split(masked, rf"[^\p{{L}}\p{{N}}{MASK}]+"), lambda w: (F.length(w) >= 3) & ~F.contains(w, F.lit(MASK))), F.lower))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with by(first place not yet replaced, span) in place of each span; spans are in order of their start.

    The text is read in pieces of CHUNK code points, so that the work stays in proportion to it."""

    def run(x: Column) -> Column:
        def part(at: Column, n: Column) -> Column:
            first = F.floor(at / CHUNK).cast("int")
            chunks = F.slice(x["chunks"], first + 1, F.floor((at + n) / CHUNK).cast("int") - first + 1)
            return F.substring(F.array_join(chunks, ""), at - first * CHUNK + 1, n)

        def step(at: Column, s: Column) -> Column:
            more = F.concat(part(at, F.greatest(s["start"] - at, F.lit(0))), by(at, s))
            return F.struct(F.greatest(at, s["end"]).alias("at"), more.alias("out"))

        rest = F.substring(text, F.array_max(F.transform(x["spans"], lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(_scanned(x["spans"], "string", step), ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(spans.alias("spans"), chunks.alias("chunks")), run)).otherwise(text)


def _masked(text: Column, base: Column) -> Column:
    """The text with each code point of a base span masked."""
    ends = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return _replaced(text, ends, lambda at, s: F.repeat(F.lit(MASK), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame, least_docs: int = 2, disclosure: float = 0.5, least_bits: float = 3.0) -> DataFrame:
    """``docs`` with base (the base spans) and added (array<struct<kind, start, end>>: disclosing terms), as a written table.

    A term discloses an entity if at least ``least_docs`` rows have both (the term outside of base spans), those
    are at least the share ``disclosure`` of the rows with the term anywhere in the corpus, and seeing the term
    tells at least ``least_bits`` bits about the entity (pointwise mutual information). It is added wherever it
    stands, in rows without the entity too. Every row counts in these statistics. A null text is empty; rows are
    told apart by place, so rows without an id and repeated rows are treated each."""
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("base", base_spans(text)).withColumn("row_key", F.monotonically_increasing_id())
    base = base.withColumn("masked", F.when(F.size("base") > 0, _masked(text, F.col("base"))))
    base = written(base, "spans").withColumn("masked", F.coalesce("masked", text))
    some = base.where(F.size("base") > 0).select("row_key", "masked", F.array_distinct(F.transform("base", lambda s: F.lower(s["match"]))).alias("entities"))
    entities = written(some.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= least_docs), "entities")
    # only entities of enough rows can be disclosed; rows without one are not taken apart
    of_row = some.select("row_key", F.explode("entities").alias("entity")).join(entities, "entity", "left_semi").groupBy("row_key").agg(F.collect_list("entity").alias("of_row"))
    both = some.join(of_row, "row_key").select("of_row", _terms(F.col("masked")).alias("terms"))
    pairs = both.select("of_row", F.explode("terms").alias("term")).select(F.explode("of_row").alias("entity"), "term")
    pairs = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= least_docs), "pairs")
    # how many rows have each of these terms: a fixed table of slots keeps most other terms from being shuffled
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int")
    slotted = lambda rows, of: rows.withColumn("slot", slot).join(F.broadcast(of.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    terms = slotted(base.select(F.explode(_terms(F.col("masked"))).alias("term")), pairs).groupBy("term").agg(F.count("*").alias("having"))
    rows = base.count()
    bits = F.log2(F.col("together") * F.lit(float(rows)) / (F.col("of_entity") * F.col("having")))
    telling = pairs.join(terms, "term").join(entities, "entity").where((F.col("together") >= disclosure * F.col("having")) & (bits >= least_bits))
    telling = written(telling.select("term").distinct(), "telling")
    at = slotted(base.select("row_key", F.explode(_terms(F.col("masked"))).alias("term")), telling).join(telling, "term", "left_semi")
    at = at.groupBy("row_key").agg(F.collect_list("term").alias("terms"))
    out = base.join(at, "row_key", "left")
    # a term that reaches into a base span is masked in part, and so isn't one of these
    found = _matches(F.col("masked"), TERM, "term", lambda m: F.array_contains("terms", F.lower(m)))
    added = F.transform(found, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.withColumn("added", F.when(F.col("terms").isNotNull(), added).otherwise(none)).drop("terms", "row_key", "masked")


def personal_data(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the number of base spans by kind, a digest of them, and all spans.

    See ``spans``; a text without spans has the digest of the empty text and an empty ``spans``."""
    found = spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat(bare, F.col("added"))).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans of its texts generalised to their kind, as in ``<email>``, and disclosing terms removed.

    Where spans overlap, the first holds and the others go with it. Null texts stay null, and texts without
    spans as they are. An n_chars column follows the text."""
    columns = docs.columns
    found = spans(docs)
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("by")))
    gone = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("by")))

    clean = _replaced(F.col("text"), F.array_sort(F.concat(bare, gone)), lambda at, s: F.when(s["start"] >= at, s["by"]).otherwise(""))
    touched = (F.size("base") > 0) | (F.size("added") > 0)
    out = found.withColumn("text", F.when(touched, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
