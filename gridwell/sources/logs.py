"""Result logs of benchmark runs as tables, and the best row of each matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What the logs say before each figure.
_HEADING = r"(?:^|\n)===== Dataset: "
_FIELDS = {"flops": (r"FLOPs:\s*(\d+)", "long"), "kernel": (r"Kernel:\s*(\d+)", "int"), "mixed_acc": (r"\[mixed_acc\]\s*([^\n]+)", "string"), "average_ms": (r"Average time:\s*([\d.]+)\s*ms", "double"), "average_gflops": (r"Average GFLOPS:\s*([\d.]+)", "double")}


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, dataset, flops, kernel, mixed_acc, average_ms, average_gflops): a row for each heading of a dataset.

    The first figure after a heading counts, what is missing is null; text before the first heading is no row. A log is
    read whole, so it is one row's memory; many logs are many tasks.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", _HEADING)).alias("at", "block")).filter("at > 0")

    def found(pattern: str, kind: str) -> Column:
        text = F.trim(F.regexp_extract("block", pattern, 1))
        return F.when(text != "", text).cast(kind)

    return blocks.select("file", "at", F.trim(F.regexp_extract("block", r"^(.+?) =====", 1)).alias("dataset"), *[found(*f).alias(c) for c, f in _FIELDS.items()])


def best_rows(df: DataFrame, key: str, cost: str, order: str) -> DataFrame:
    """The row of each key with the least cost, ties by `order`; keys without any cost go, rows without a key stay."""
    named = df.filter(F.col(key).isNotNull() & F.col(cost).isNotNull())
    best = named.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*df.columns), F.struct(cost, order)).alias("__row")).select("__row.*")
    return best.unionByName(df.filter(F.col(key).isNull()))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files of comma-separated values, each with a heading."""
    df.write.csv(path, header=True)
