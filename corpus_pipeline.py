"""From raw documents to packed training sequences: every stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from friction.llm.common import deleted, read_table, shared_dir
from friction.llm.exact_dedup import drop_copies
from friction.llm.mixing import mixed_documents
from friction.llm.near_copies import drop_similar
from friction.llm.packing import sequences
from friction.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic. Null and empty texts stay."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents with one normalised text, the row with the smallest doc_id. Null texts count as empty."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of texts whose five-word shingles are similar by 0.8, the row with the smallest doc_id: BK-trees
    over SimHash fingerprints find the pairs, whole sets of shingles decide."""
    return drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix of sources wants it: not, once or twice. Rows without words go."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of every row, in pieces if it is long, into sequences of the permitted lengths."""
    return sequences(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]

#: SQL can express neither a fitted chain nor XXH64 nor the cube method.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            deleted(spark, before)
        before = f"{at}/{name}"
    return docs
