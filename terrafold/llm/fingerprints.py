"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle is hashed once; the high bits of the hash choose a bin, and a bin keeps its least hash. An
empty bin takes the value of a bin chosen by a hash of both bin numbers among those that aren't empty
(optimal densification). The packed fingerprint has the low bits of each value; a likeness corrects the
share of equal values for those that agree by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
_EMPTY = (1 << (64 - BIN_BITS)) - 1  # the least hash of a bin stands above all others of the bin if it is empty


def _binned(words: Column, k: int) -> Column:
    """Hashes of the runs of k words (of all words, if fewer) and the top value of every bin, in order."""
    # the hash of the words from i on, for every i at once: one slice and one hash each
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1)))
    hashes = F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))
    tops = F.transform(F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_EMPTY)))
    return F.sort_array(F.concat(hashes, tops))


def _firsts(ordered: Column) -> Column:
    """The first of each bin; as every bin has its top value, there are BINS."""
    return F.filter(
        ordered,
        lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.element_at(ordered, F.greatest(i, F.lit(1))), 64 - BIN_BITS)),
    )


def fingerprinted(df: DataFrame, text: str, out: str, k: int = 5) -> DataFrame:
    """``df`` with ``out``: array<int> of BINS low-bit values; the array of a text without words is all zero.

    Words are lower-cased and have no white space."""
    low = lambda v: v.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")
    is_empty = lambda v: v.bitwiseAND(F.lit(_EMPTY)) == F.lit(_EMPTY)
    df = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("_ordered", _binned(F.col("_words"), k)).withColumn("_bins", _firsts(F.col("_ordered")))
    full = F.filter(F.col("_bins"), lambda v: ~is_empty(v))
    df = df.withColumn("_full", full)
    donor = lambda i: F.array_min(F.transform("_full", lambda v: F.struct(F.xxhash64(F.shiftright(v, 64 - BIN_BITS), i).alias("h"), v.alias("v"))))["v"]
    filled = F.transform("_bins", lambda v, i: F.when(is_empty(v), low(donor(i))).otherwise(low(v)))
    zero = F.array_repeat(F.lit(0), BINS)
    return df.withColumn(out, F.when(F.size("_full") == 0, zero).when(F.size("_full") == BINS, F.transform("_bins", low)).otherwise(filled)).drop("_words", "_ordered", "_bins", "_full")


def packed(fp: Column) -> Column:
    """The low bits of all values as one hexadecimal text."""
    return F.lower(F.array_join(F.transform(fp, lambda v: F.substring(F.hex(v.cast("long") + 256), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, from 0 to 1: the share of equal values, less those equal by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def followers(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next smaller id, and the largest after the smallest.

    Ids are dealt into ranges, each is ordered by itself, and one row a range joins them."""
    n = partitions(ids.sparkSession)
    ranged = written(ids.repartitionByRange(n, "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("largest"))  # a row for each range
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("largest").over(order), F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    mine = Window.partitionBy("part").orderBy("doc_id")
    return ranged.withColumn("lower", F.lag("doc_id").over(mine)).join(F.broadcast(ends), "part").select("doc_id", F.coalesce("lower", "before").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) with its fingerprint, its edited text's, and their likeness.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document, in descending doc_id; after the smallest comes the largest (itself, if alone). A null text
    is empty. Rows without a doc_id have no place in that order: they are their own next document. Rows that
    share a doc_id are kept each; of a next document with several rows the least beginning and the least
    fingerprint are taken. Texts without words have the zero fingerprint, and a likeness of 1 to each other.
    Other columns are ignored."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("longest"))
    sizes = written(sizes, "sizes")
    chain = followers(sizes.select("doc_id")).join(sizes, "doc_id").withColumn("take", F.floor(F.col("longest") / 3).cast("int")).drop("longest")
    chain = written(chain, "followers")
    # both joins read the texts from one exchange
    dealt = rows.where("doc_id is not null").repartition(n, "doc_id")
    heads = dealt.select(F.col("doc_id").alias("next_id"), "text").join(chain, "next_id").select("doc_id", F.substring("text", F.lit(1), F.col("take")).alias("head"))
    heads = heads.groupBy("doc_id").agg(F.min("head").alias("head"))
    joined = dealt.join(heads, "doc_id").unionByName(rows.where("doc_id is null").withColumn("head", F.col("text")))
    size = F.length("text")
    moved = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - moved), F.substring("head", F.lit(1), moved))
    both = joined.select("doc_id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = fingerprinted(fingerprinted(both, "text", "fp"), "edited", "efp")
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").cast("array<smallint>"), F.col("efp").cast("array<smallint>"))
    both = written(both, "fingerprints")
    fp_next = both.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp_next")).withColumnRenamed("doc_id", "next_id")
    out = both.join(chain.select("doc_id", "next_id"), "doc_id", "left").join(fp_next, "next_id", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.coalesce("fp_next", "fp")).alias("near_next"),
    )
