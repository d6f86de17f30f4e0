"""All pairs of buckets with many copies."""

import random

import pytest
from pyspark.sql import functions as F

from gridwell.operators import cluster, lsh
from gridwell.operators.matrix import Matrix


@pytest.mark.parametrize("cap", [1, 2, 3, 8])
def test_settled_copies_leave_the_roots_of_all_pairs(spark, monkeypatch, cap):
    """Groups of 1 to 40 copies, near copies and empty rows, numbered over several cells."""
    monkeypatch.setattr(cluster, "SCAN_BUCKET", 16)
    r, rows = random.Random(cap), []
    for n in (1, 2, 3, 7, 8, 9, 16, 17, 40):
        own = {r.randrange(60) for _ in range(12)}
        rows += [own] * n + [own ^ {r.randrange(60)} for _ in range(3)]
    rows += [set()] * 11
    r.shuffle(rows)
    m = Matrix(spark.createDataFrame([(i, j, 1.0) for i, own in enumerate(rows) for j in own], "i long, j long, v double"), len(rows), 60)
    sigs = {x.i: x.sig for x in lsh.signatures(m, 16, 7).collect()}
    part = lambda i: {(b, *sigs[i][4 * b : 4 * b + 4]) for b in range(4)}
    pairs = [(i, j, sum(a == b for a, b in zip(sigs[i], sigs[j])) / 16) for i in sigs for j in sigs if i < j and part(i) & part(j)]
    want = cluster.agglomerate(pairs, dict(enumerate(rows)), cap)
    got = {x.i: x.root for x in cluster.preprocess(m, 16, 4, 7, cap, capped=False).collect()}
    assert got == {i: want.get(i, i) for i in range(len(rows))}


def test_pairs_of_copies_are_not_unfolded(spark, monkeypatch):
    """300 copies of a row would make 44,850 pairs; 4 of them stay open after 37 clusters of 8."""
    told, plain = [], cluster.hierarchical
    monkeypatch.setattr(cluster, "hierarchical", lambda m, pairs, *rest: told.append(pairs.count()) or plain(m, pairs, *rest))
    m = Matrix(spark.range(300).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 5, 9)])).alias("j"), F.lit(1.0).alias("v")), 300, 10)
    sizes = cluster.preprocess(m, capped=False).groupBy("root").count().collect()
    assert told == [6] and sorted(x["count"] for x in sizes) == [4] + [8] * 37
