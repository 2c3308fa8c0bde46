"""The corpus pipeline: toxicity, near duplicates, personal data, mixing and packing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import table, written
from terrafold.llm.jaccard import jaccard_join
from terrafold.llm.mixing import mixed
from terrafold.llm.packing import best_fit
from terrafold.llm.private import sanitised
from terrafold.llm.queries import tokenizer_file
from terrafold.llm.toxicity import accepted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least doc_id. Documents without words are linked with nothing and stay.

    A row is known by its id and text, so unlike texts of one doc_id, and rows without an id, are documents of their own."""
    row = F.xxhash64("doc_id", "text").alias("_row")
    said = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    told = docs.where(said)
    groups = jaccard_join(told.select(row.alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    named = groups.join(told.select(row, "doc_id").distinct(), "_row")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = named.groupBy("component_id").agg(first.alias("_row")).select("_row")
    out = told.withColumn("_row", row).join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return out.select(*docs.columns).unionByName(docs.where(~said))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms removed."""
    return sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for; no rate is under 1, so none is lost."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return best_fit(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("personal data", hide_personal_data), ("mixing", mix), ("packing", pack)]

#: The stages learn, link and tokenise in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
