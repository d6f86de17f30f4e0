"""Corpus pipeline: toxic documents go, repeated passages are cut, one of each near-duplicate group stays, leaked
benchmark documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir); run() writes its result as Parquet in the shared folder and reads it again.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwell.llm import contain, deobfuscate, line_chunks, queries, simhash, word_bpe
from gridwell.plans.runtime import materialize, quoted, small, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold. Null and empty texts, null and repeated ids and equal
    rows stay, long texts count whole, columns may have any name; no documents give none."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), "doc_id", "text")
    scored = queries.toxicity(spark, rows, sf_dir, ["row"])
    return scored.filter(F.col("score") < deobfuscate.THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the chunks of lines that an earlier place holds; n_chars is counted anew where text changed.

    Null and empty texts stay; rows with one id (null too) and one text lose the same lines; no documents give none.
    """
    count = "lines_removed"
    while count in docs.columns:
        count += "_"
    out = line_chunks.dedup_lines(docs, count)
    anew = F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[anew.cast(out.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id, null last, then the smallest text hash. Null and empty texts are one
    group; rows that share an id but no group all stay; no documents give none."""
    return simhash.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, whatever other rows share their id. Null ids count like others, null
    and empty texts contain nothing and stay, equal rows stay or go together; no documents give none."""
    leaks = contain.matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "dkey").distinct()
    leaks = materialize(leaks, "pipeline-leaks").withColumnsRenamed({"doc_id": "leaked"})
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"))
    return rows.join(small(leaks), F.col("own").eqNullSafe(F.col("leaked")) & (F.col("hash") == F.col("dkey")), "left_anti").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: a row for each document, null texts as empty ones, null ids as they are."""
    return word_bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]
#: SQL has no Viterbi decoding, XXH64 or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
