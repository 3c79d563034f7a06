"""A corpus made ready for training, in five stages over the documents.

Each stage takes the documents that the one before kept; ``run`` writes every
stage's rows to the shared folder and reads them again.  All but the last
return the columns of ``documents``, whatever others there are beside the five.

Defined cases, in every stage: null and empty texts are rows like others, very
long texts are taken whole, and an empty table gives an empty one; what else is
defined stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, chosen_path, line_dedup, mixing, quality
from plumbline.llm.queries import QUALITY_LEAST, ranks_path, remainder
from plumbline.llm.shared import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``QUALITY_LEAST``.

    A null or empty text has the score of the bias alone; rows without id are
    scored, not learned from; repeated rows go or stay together; without any
    label all scores are 0.5 and all rows stay.  Other columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, F.coalesce(remainder("doc_id", 5) != 0, F.lit(False)))
    return docs.where(quality.score_of(docs, weights) >= QUALITY_LEAST)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those of which nothing is left go.

    Earlier is by id (null first), hash of the text, line.  A document that has
    lost no line stays as it is, also a null, empty or white one; rows with equal
    id and text lose the same lines and so stay or go together.
    """
    found = line_dedup.line_dedup(docs, name="pipeline_lines")
    return found.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]")).select(docs.columns)


def new_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The smallest id stays (a null one where the group has no other); among rows
    with that id the smallest hash of the text, then of the whole row.  Texts
    without words are in no group, and all their rows stay.
    """
    return chosen_path.deduplicated(docs, name="pipeline_documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh the same, in a random order.

    A null source is a source; every row, also a repeated one or one without an
    id, is drawn by itself.
    """
    return mixing.mix_sources(docs, copy=None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of ids and of the bytes they decode to, a row for each of ``docs``; null and empty texts have none."""
    return byte_bpe.byte_bpe(docs, ranks_path(), outputs=("ids",))


STAGES = [
    ("quality classifier", good),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", new_documents),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL has no byte-level BPE; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, "pipeline_stage")
    return docs
