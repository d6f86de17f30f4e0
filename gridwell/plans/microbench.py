"""Seconds of hash and dense accumulators at several densities."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwell.plans.runtime import materialize


def accumulators(spark: SparkSession, cells: int = 1 << 16, rows: int = 64, densities=(0.02, 0.1, 0.3, 0.5), repeat: int = 2) -> DataFrame:
    """(density, products, hash_s, dense_s, faster): the same products into `rows` x `cells` cells by hash aggregation
    and by one dense block a row, the best of `repeat` runs each. Products are written first and count for neither."""
    out = []
    for density in densities:
        n = int(cells * density)
        made = materialize(spark.range(rows * n).select((F.col("id") % rows).alias("i"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("j"), F.lit(1.1).alias("p")).repartition(rows, "i").sortWithinPartitions("i"), "products")

        def dense(batches):
            cell, hit, now = np.zeros(cells), np.zeros(cells, bool), None

            def close():
                at = np.flatnonzero(hit)
                batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at), pa.array(cell[at])], names=["i", "j", "v"])
                cell[at], hit[at] = 0, False
                return batch

            for batch in batches:
                i, j, p = (batch.column(k).to_numpy() for k in range(3))
                for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
                    if now is not None and now != i[own[0]]:
                        yield close()
                    now = i[own[0]]
                    np.add.at(cell, j[own], p[own])
                    hit[j[own]] = True
            if now is not None:
                yield close()

        def seconds(run) -> float:
            best = None
            for _ in range(repeat):
                began = time.perf_counter()
                run().write.format("noop").mode("overwrite").save()
                best = min(time.perf_counter() - began, best or 1e9)
            return best

        by_row = made.repartition(rows, "i").sortWithinPartitions("i")
        hashed = seconds(lambda: made.groupBy("i", "j").agg(F.sum("p").alias("v")))
        blocks = seconds(lambda: by_row.mapInArrow(dense, "i long, j long, v double"))
        out.append((float(density), rows * n, hashed, blocks, "hash" if hashed < blocks else "dense"))
    return spark.createDataFrame(out, "density double, products long, hash_s double, dense_s double, faster string")
