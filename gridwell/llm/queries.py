"""The queries of this package by name, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwell.llm import contain, deobfuscate, ftrl, line_chunks, media, simhash, template, token_shards, url_tree, word_bpe
from gridwell.plans.runtime import table


def _held_out(parts: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.read_shards(token_shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str]) -> DataFrame:
    """score of every row of docs; labels are learnt from the table's rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter("label is not null and doc_id is not null")
    return deobfuscate.score(docs, deobfuscate.train(docs, labels, ~_held_out(4, 2)), keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(spark, table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])
    return got.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= deobfuscate.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter("label is not null and doc_id is not null")
    weights = ftrl.train(docs, labels, ~_held_out(5, 0))
    got = ftrl.score(docs, weights, ["doc_id"])
    return got.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_line_dedup, op3_token_shards, op4_toxicity, op5_simhash, op6_word_bpe, op7_quality, op8_decontamination, op9_media, op10_html_extraction)} | {"pipeline": _pipeline}
ORACLE_SQL = {"op1_url_filters": url_tree.oracle(), "op8_decontamination": contain.ORACLE}
