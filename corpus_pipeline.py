"""From raw documents to packed training sequences.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame`` and works on all
that the stage before it kept; ``run`` writes each stage's result to a table in
the shared folder and hands that to the next.  All but the last return the columns
of ``documents``.

1. ``toxicity``: documents with a toxicity score of one half or more go.
2. ``quality``: documents with a quality score under one half go.
3. ``simhash``: of each group of near-duplicates one document stays.
4. ``suffix_dedup``: byte strings that repeat a document with a smaller id are cut.
5. ``packing``: where each document goes in sequences of 2048 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adpulse.llm import best_fit, golay_simhash, mil_quality, nb_toxicity, suffix_dedup
from adpulse.llm.runtime import keep, prepare


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nb_toxicity.clean(docs, nb_toxicity.train(docs, _labels(spark, sf_dir)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil_quality.accepted(docs, mil_quality.train(docs, _labels(spark, sf_dir)))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_simhash.keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("simhash", simhash), ("suffix_dedup", suffix), ("packing", packing)]

# Trained models, fingerprints and packing are beyond SQL: the stages are tested
# one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
