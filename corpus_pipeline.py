"""The corpus pipeline: stages over the documents table, each written before the next one reads it.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
The first four return the columns of documents, the last one the packed pieces.
Tables and labels are read from ``sf_dir``; extra columns of documents pass through.

Edge cases are those of the operators: null texts are packed as empty, rows with a
null doc_id are kept by the filters, rows that share a doc_id are dropped together,
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.llm import lines, nearsets, packing, substrings, toxicity
from eligora.llm.names import fresh
from eligora.llm.queries import table, tokenizer_path
from eligora.session import ensure_checkpoint_dir

#: A document is dropped when it is this likely toxic; clean ones are to stay.
TOXIC = 0.5
#: Near duplicates: words in a shingle, and similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``rejected``; rows without an id stay."""
    (gone,) = fresh(docs.columns, "rejected_id")
    ids = rejected.where("doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity operator scores ``TOXIC`` or more; rows without an id stay."""
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where(F.col("score") >= TOXIC))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes multi-line chunks that have occurred before out of the texts."""
    return lines.without_repeats(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    found = nearsets.near_components(docs, SHINGLE, SIMILAR)
    return _without(docs, found.where(~F.col("kept")))


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that stand in a document with a smaller id, or earlier in the same one, out of the texts."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with a CRC-32 of each piece's ids."""
    return packing.packed_digests(docs, tokenizer_path())


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("near_dedup", near_out), ("substring_dedup", passages_out), ("packing", packed)]

#: Language models, content-defined chunks by other hashes and a tokenizer can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet into the shared folder and read again by the next stage."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
