"""The corpus pipeline: five stages over ``documents``, each one of the
training-data operators of ``tillroll.llm``.

1. quality: documents that the line classifier rejects go.
2. near_duplicates: of each group of near-duplicates one document stays (4-word
   shingles, 4 bits).
3. decontamination: documents that hold a benchmark item go.
4. mixing: sources are dealt to their target weights; no document is lost, those
   of small sources come up to twice.
5. token_shards: what is left as token ids in training order; a row per sequence.

Every stage works on all rows its predecessor kept and gives back its columns,
but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontam, mixing, quality, simhash, tokens
from tillroll.llm.common import read, write_table
from tillroll.llm.queries import not_held_out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of 0.7 or more; rows without text have the
    training documents' share of good ones as their score."""
    model = quality.train(docs, read(spark, sf_dir, "labels").where(not_held_out("doc_id", 4, 2)))
    scored = quality.score(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return simhash.keep_one(docs, shingle_words=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark item."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the sources to their weights."""
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; a row per sequence."""
    return tokens.materialise(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token_shards", token_stage)]

#: A trained classifier, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs
