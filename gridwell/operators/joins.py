"""Equi-joins whose heavy keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwell.plans.runtime import small

#: Joined rows of one key from which it is dealt to several tasks.
HEAVY_ROWS = 50_000_000
#: Parts of a key at most: what its right rows are repeated.
MOST_PARTS = 1024


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], heavy: int | None = None) -> DataFrame:
    """The inner join of left and right on `keys`.

    A key costs count_left * count_right rows, which neither side's bytes show. Keys over `heavy` are salted: left rows are
    dealt to parts by the hash of their `spread` columns, right rows are repeated for each part. Both counts are partial
    aggregates; only keys over `heavy` go any further.
    """
    heavy = heavy or HEAVY_ROWS
    cost = left.groupBy(*keys).agg(F.count("*").alias("__nl")).join(right.groupBy(*keys).agg(F.count("*").alias("__nr")), keys)
    rows = F.col("__nl").cast("double") * F.col("__nr")
    hot = cost.filter(rows > heavy).select(*keys, F.least(F.lit(MOST_PARTS), F.ceil(rows / heavy)).cast("int").alias("__parts"))
    if not hot.limit(1).count():
        return left.join(right, keys)
    hot = small(hot)
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"), F.lit(0))
    dealt = left.join(hot, keys, "left").withColumn("__salt", part).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))
    return dealt.join(right.join(hot, keys, "left").withColumn("__salt", copies).drop("__parts"), [*keys, "__salt"]).drop("__salt")
