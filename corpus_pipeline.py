"""Corpus pipeline: quality, language, near-duplicates, packing. Each stage works on all that its predecessor kept.

All stages but the last return rows of ``documents`` as they are, with all their columns, whatever these are called. Defined results:
a null or empty text passes the quality stage (it has no score) and goes at the language stage (it has no language); a null id is an ordinary document that has no near-duplicates; rows
that share an id are judged one by one, but for near-duplicates they are one document, of which one row stays; repeated texts
under other ids are near-duplicates; very long texts are read whole. Without labels of both classes the quality stage keeps all, and without any document
of a known language the language stage keeps none. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import langid, minhash, packing, quality
from loomgraph.llm.common import read, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: tier, window, offset, step group."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: The classifiers, the similarity join and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
