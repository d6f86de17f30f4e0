"""Pairs of buckets, best first, and the clustering that takes them so."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwell.operators import best_first, cluster, lsh
from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import by_kind


def signatures(seed, n, k):
    """Groups of near copies over few values, so that buckets of all sizes come up."""
    r = np.random.default_rng(seed)
    sig = r.integers(0, 3, (max(1, n // 15), k))[r.integers(0, max(1, n // 15), n)]
    return np.where(r.random((n, k)) < 0.2, r.integers(0, 3, (n, k)), sig).astype(np.int32)


def every_pair(sig, bands):
    n, k = sig.shape
    share = lambda i, j: any((x == y).all() for x, y in zip(np.split(sig[i], bands), np.split(sig[j], bands)))
    return [(int((sig[i] == sig[j]).sum()), i, j) for i in range(n) for j in range(i + 1, n) if share(i, j)]


def tight(monkeypatch):
    for name, value in (("HELD_PAIRS", 400), ("FEW_ROWS", 5), ("GATHERED", 16), ("SIDE", 4), ("ACROSS", 7)):
        monkeypatch.setattr(best_first, name, value)


@pytest.mark.parametrize("n,k,bands", [(120, 16, 4), (90, 12, 4), (60, 300, 100), (3, 16, 4), (1, 16, 4)])
def test_all_pairs_come_once_and_in_order(monkeypatch, n, k, bands):
    tight(monkeypatch)
    sig = signatures(n, n, k)
    got = [x for chunk in best_first.BestFirst(sig, bands).pairs(lambda: np.ones(n, bool)) for x in zip(*(c.tolist() for c in chunk))]
    assert got == sorted(every_pair(sig, bands), reverse=True)


@pytest.mark.parametrize("strategy", cluster.BOOKS)
def test_roots_are_those_of_all_pairs(monkeypatch, strategy):
    """Many passes; rows that closed have left the buckets."""
    tight(monkeypatch)
    for seed in range(6):
        r = random.Random(seed)
        n, cap = r.randint(2, 150), r.choice([1, 2, 3, 8])
        sig, rows = signatures(seed, n, 16), [sorted({r.randrange(12) for _ in range(r.randrange(9))}) for _ in range(n)]
        batch = pa.RecordBatch.from_pydict({
            "part": pa.array(np.zeros(n, np.int64)), "kind": pa.array(np.zeros(n, np.int32)), "i": pa.array(np.arange(n) * 3),
            "cols": pa.array([x or None for x in rows], pa.list_(pa.int32())), "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
        })
        [(_, got)] = ((part, cluster._bucket_component(held, 4, 16, np.int32, cap, strategy)) for part, held in by_kind([batch.slice(0, 40), batch.slice(40)]))
        want = cluster.agglomerate([(i, j, same / 16) for same, i, j in every_pair(sig, 4)], {i: set(x) for i, x in enumerate(rows)}, cap)
        assert got.column("root").to_pylist() == [3 * want.get(i, i) for i in range(n)]


def test_no_frame_holds_the_pairs(spark, monkeypatch):
    """600 near copies make about 180,000 pairs, which are neither joined nor written."""
    monkeypatch.setattr(lsh, "bucket_pairs", lambda *_, **__: pytest.fail("pairs were formed"))
    cells = spark.range(600).select(F.col("id").alias("i"), F.explode(F.concat(F.sequence(F.lit(0), F.lit(60)), F.array(F.col("id") + 100))).alias("j"), F.lit(1.0).alias("v"))
    sizes = cluster.preprocess(Matrix(cells, 600, 1000), capped=False).groupBy("root").count().agg(F.sum("count"), F.max("count")).first()
    assert sizes[0] == 600 and 8 <= sizes[1] <= 14


def test_links_connect_buckets_and_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(lsh, "SCAN_BUCKET", 8)
    sig = signatures(5, 70, 16) * 40
    frame = spark.createDataFrame([(i, bytearray(x.astype(np.int32).tobytes())) for i, x in enumerate(sig)], "i long, sig binary")
    found = lsh.Buckets(frame, 16, 4, 100)
    pairs = {(i, j) for _, i, j in every_pair(sig, 4)}
    assert found.count() == len(pairs) and {tuple(x) for x in found.frame().collect()} == pairs
    links = {(x.j, x.i) for x in found.links().collect()}
    parts = lambda edges: {frozenset(x) for x in _parts(edges)}
    assert links <= pairs and parts(links) == parts(pairs) and len(links) <= 70 * 8
    assert lsh.Buckets(frame, 16, 5, 100).links().count() == 0


def _parts(edges):
    parts = {}
    for i, j in edges:
        own = parts.get(i, {i}) | parts.get(j, {j})
        parts.update(dict.fromkeys(own, own))
    return parts.values()
