"""A training-data pipeline of five filtering and coding stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its
predecessor kept; all but the last return the columns of ``docs``. ``run`` writes each
stage's result as Parquet in the shared checkpoint folder and reads it again, so a lost
executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diurna.llm import bpe, decontam, jaccard_join, quality_model, toxicity
from diurna.llm.common import read, written
from diurna.llm.queries import WORD_BPE, vocabulary

# The classifiers' values and the exact tokenizer are beyond SQL; stages are tested by brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    return quality_model.score(docs, weights, prefix="__").where("__predicted = 1").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject."""
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, prefix="__").where("not __toxic").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.with_matches(docs, read(spark, sf_dir, "benchmark"), name="__matches")
    return found.where("size(__matches) = 0").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: their ids, with digests of these and of the text they decode to."""
    return bpe.round_trip(docs, vocabulary(WORD_BPE).decode(), ["doc_id"], with_ids=True)


STAGES = [("quality_classifier", quality), ("toxicity", toxic), ("jaccard_join", near_duplicates),
          ("decontamination", decontamination), ("bpe", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
