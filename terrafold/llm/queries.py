"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@registered
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), tokenizer_file())


@registered
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@registered
def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE["op5_approximate_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


@registered
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@registered
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@registered
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@registered
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(table(spark, sf_dir, "documents"))


@registered
def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


@registered
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passages

    return passages(table(spark, sf_dir, "documents"))


@registered
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash

    return simhash(table(spark, sf_dir, "documents"))


@registered
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@registered
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair

    return repair(table(spark, sf_dir, "conversations"))
