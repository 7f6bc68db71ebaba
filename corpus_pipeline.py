"""The training-data pipeline over ``documents``: STAGES in order, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from albumetrics.llm import bpe_stream, edit_matching, language_spans, toxicity, weighted_minhash
from albumetrics.llm.common import table
from albumetrics.llm.queries import WORD_BPE, language_model, toxicity_scorer
from albumetrics.sources.workspace import Scratch


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one known language covers at least half of the letters; the others go."""
    return language_spans.keep_identified(docs, language_model(spark, sf_dir))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, toxicity_scorer(spark, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of exact and near copies."""
    return weighted_minhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return edit_matching.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, the digest of its ids and that of the text they decode to."""
    return bpe_stream.digests(docs, WORD_BPE)


STAGES = [
    ("language_spans", keep_identified),
    ("toxicity", keep_clean),
    ("weighted_minhash", keep_one_of_each_group),
    ("edit_matching", keep_uncontaminated),
    ("bpe_stream", encode_and_decode),
]

#: Learned models and approximate search have no SQL; tests compare what stages keep with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
