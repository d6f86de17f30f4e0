"""Exact row similarity and clusters of consecutive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwell.operators.joins import heavy_join
from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import materialize


def exact_jaccard(m: Matrix, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs(a, b): shared columns over all columns of both rows; 0 for two empty rows."""
    cells = m.entries.select("i", "j").distinct()
    size = cells.groupBy("i").agg(F.count("*").alias("n"))
    one = pairs.select("a", "b").distinct()
    left = heavy_join(one, cells.withColumnRenamed("i", "a"), ["a"], ["b"])  # a row in many pairs is dealt by its partners
    shared = left.join(cells.withColumnRenamed("i", "b"), ["b", "j"]).groupBy("a", "b").agg(F.count("*").alias("c"))
    held = one.join(shared, ["a", "b"], "left").join(size.select(F.col("i").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b", "left")
    c, union = F.coalesce("c", F.lit(0)), F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - F.coalesce("c", F.lit(0))
    return held.select("a", "b", F.when(union > 0, c / union).otherwise(0.0).alias("jaccard"))


def consecutive_clusters(m: Matrix, threshold: float = 0.3, most: int = 8, eps: float = 1e-6) -> DataFrame:
    """(cluster, start, stop): a cluster goes on while the next row's similarity to its first row reaches the threshold.

    How far a cluster would reach is found for every row at once from the similarities to the next most - 1 rows; the
    starts are what row 0 reaches by following these steps, found by doubling them.
    """
    rows = m.rows()
    near = rows.select(F.col("i").alias("a"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + most - 1)).alias("b")).filter(F.col("b") < m.nrows) if most > 1 else rows.limit(0).select(F.col("i").alias("a"), F.col("i").alias("b"))
    fails = exact_jaccard(m, near).filter(F.col("jaccard") < threshold - eps).groupBy("a").agg(F.min("b").alias("stop"))
    step = rows.join(fails, F.col("i") == F.col("a"), "left").select("i", F.least(F.coalesce("stop", F.col("i") + most), F.lit(m.nrows)).alias("to"))
    once = step = materialize(step, "cluster-steps")
    starts, reach = rows.filter("i = 0"), 1
    while reach < m.nrows:
        starts = materialize(starts.join(step, "i").select(F.col("to").alias("i")).filter(F.col("i") < m.nrows).unionByName(starts).distinct(), "cluster-starts")
        step = materialize(step.alias("s").join(step.alias("t"), F.col("s.to") == F.col("t.i")).select(F.col("s.i").alias("i"), F.col("t.to").alias("to")), "cluster-steps")
        reach *= 2
    from gridwell.operators.matrix import rank_by_count

    ends = starts.join(once, "i").select("i", F.col("to").alias("stop"))
    numbered = rank_by_count(ends.select((F.lit(m.nrows) - F.col("i")).alias("i"), F.lit(0).alias("n")))
    return numbered.select((F.lit(m.nrows) - F.col("i")).alias("i"), F.col("new_row").alias("cluster")).join(ends, "i").select("cluster", F.col("i").alias("start"), "stop")


def equal_clusters(m: Matrix, size: int) -> DataFrame:
    """(cluster, start, stop) of `size` rows each, the last one shorter."""
    return m.entries.sparkSession.range(-(-m.nrows // size)).select(F.col("id").alias("cluster"), (F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(m.nrows)).alias("stop"))
