"""Signatures of rows whose entries arrive as a stream: minima merge, so the batch aggregation runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwell.functions.mod64 import affine, unsigned_min
from gridwell.operators.lsh import coefficients


def streaming_signatures(entries: DataFrame, k: int = 64, seed: int = 12345) -> DataFrame:
    """(i, sig) of a streaming entries(i, j); write it in update or complete mode. State is one signature a row."""
    held = entries.groupBy("i").agg(*[unsigned_min(affine(a, b, F.col("j"))).alias(f"h{d}") for d, (a, b) in enumerate(coefficients(k, seed))])
    return held.select("i", F.array(*[f"h{d}" for d in range(k)]).alias("sig"))
