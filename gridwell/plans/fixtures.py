"""Matrices derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import table

#: Token columns are 28-bit hashes: no global numbering is needed.
TOKEN_COLS = 1 << 28


def _entries(i, j, v, df: DataFrame) -> DataFrame:
    return df.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum(v).alias("v"))


def supplier_part(spark: SparkSession, sf: str) -> Matrix:
    line = table(spark, sf, "lineitem")
    return Matrix(_entries("l_suppkey", "l_partkey", "l_quantity", line), table(spark, sf, "supplier").count(), table(spark, sf, "part").count())


def order_part(spark: SparkSession, sf: str, raw: bool = False) -> Matrix:
    line = table(spark, sf, "lineitem")
    cells = line.select(F.col("l_orderkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").alias("v"))
    m = Matrix(cells, table(spark, sf, "orders").count(), table(spark, sf, "part").count())
    return m if raw else m.compact(drop_zeros=False)


def part_part(spark: SparkSession, sf: str) -> Matrix:
    line = table(spark, sf, "lineitem")
    a = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("j"))
    n = table(spark, sf, "part").count()
    return Matrix(_entries("i", "j", "v", a.join(b, ["l_orderkey", "n"])), n, n)


def nation_nation(spark: SparkSession, sf: str) -> Matrix:
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return Matrix(_entries("c_nationkey", "s_nationkey", "l_quantity", line), 25, 25)


def embeddings(spark: SparkSession, sf: str) -> Matrix:
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).filter(F.abs("x") > F.lit(0.2).cast("float"))
    return Matrix(cells.select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("v")), table(spark, sf, "embeddings").count(), 64)


def document_tokens(spark: SparkSession, sf: str) -> Matrix:
    docs = table(spark, sf, "documents")
    tokens = docs.select(F.col("doc_id").alias("i"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("t")).filter("t <> ''")
    cells = tokens.select("i", F.conv(F.substring(F.md5("t"), 1, 7), 16, 10).cast("long").alias("j")).distinct()
    return Matrix(cells.withColumn("v", F.lit(1.0)), docs.agg(F.max("doc_id") + 1).first()[0], TOKEN_COLS)
