"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.llm import (
    bpe_stream,
    chat_format,
    cotraining,
    edit_matching,
    graph_search,
    language_spans,
    license_scan,
    source_mixing,
    structure_repair,
    term_pipeline,
    token_planes,
    toxicity,
    weighted_minhash,
)
from albumetrics.llm.common import held_out, table
from albumetrics.sources.workspace import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra), BYTE_BPE), BYTE_BPE)


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.nearest(graph_search.build(vectors), vectors.filter(F.col("vec_id") % 20 == 0))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def toxicity_scorer(spark: SparkSession, sf_dir: str) -> toxicity.Scorer:
    labels = table(spark, sf_dir, "labels")
    return toxicity.learn(table(spark, sf_dir, "documents"), labels, ~held_out(F.col("doc_id")))


def language_model(spark: SparkSession, sf_dir: str) -> language_spans.LanguageModel:
    return language_spans.learn(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), toxicity_scorer(spark, sf_dir))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return cotraining.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted_minhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.expr("class_id <=> doc_id").alias("keep"))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_spans.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_matching.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_planes.write(table(spark, sf_dir, "documents"), WORD_BPE)
    return token_planes.read_digests(spark, manifest)


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "term-pipeline")
    found = term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch)
    return scratch.finish(found)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "structure-repair")
    turns = structure_repair.damage(table(spark, sf_dir, "conversations"))
    return scratch.finish(structure_repair.report(turns, scratch))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "source-mixing")
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"), scratch)
    return scratch.finish(mixed.select("doc_id", "size", "source_size", "target", "taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_graph_search": op3_graph_search,
    "op4_license_scan": op4_license_scan,
    "op5_edit_matching": op5_edit_matching,
    "op6_token_planes": op6_token_planes,
    "op7_bpe_stream": op7_bpe_stream,
    "op8_cotraining": op8_cotraining,
    "op9_weighted_minhash": op9_weighted_minhash,
    "op10_language_spans": op10_language_spans,
    "op11_term_pipeline": op11_term_pipeline,
    "op12_structure_repair": op12_structure_repair,
    "op13_source_mixing": op13_source_mixing,
}

SQL: dict[str, str] = {"op4_license_scan": license_scan.oracle(), "op11_term_pipeline": term_pipeline.oracle()}
