"""The registered queries of this subpackage, each a thin use of one operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, chosen_path, embedding_dedup, kneser_ney, language_id, line_dedup, mixing, permutation_index, quality, secret_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A vocabulary file of the public tokenizers; the package gives its place.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: A document is kept if its quality score is at least this.
QUALITY_LEAST = 0.3


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id, which is then neither learned from nor held out."""
    return F.crc32(F.col(key).cast("string")) % by


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


@query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = kneser_ney.kneser_ney(docs, F.coalesce(remainder("doc_id", 5) != 1, F.lit(False)))
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


ORACLES["op4_mix_sources"] = mixing.ORACLE


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op5_line_dedup"] = line_dedup.ORACLE


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), ranks_path(), outputs=(), pattern=public_tokenizers.PATTERN)


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLES["op7_embedding_dedup"] = embedding_dedup.ORACLE


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(remainder("doc_id", 5) != 0, F.lit(False)))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, quality.score_of(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_LEAST).cast("int"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language_id.learn(docs, F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language_id.language_id(docs, samples).select("doc_id", held_out, "lang_pred", "score")


@query
def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
