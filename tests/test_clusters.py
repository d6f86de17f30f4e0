"""Products and statistics of clusters in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from gridwell.operators import layouts, spgemm, work
from gridwell.operators.matrix import Matrix


def make(spark, rows, nrows, ncols):
    return Matrix(spark.createDataFrame([(i, j, float(v)) for i, j, v in rows], "i long, j long, v double"), nrows, ncols)


def cells(r, nrows, ncols, n):
    return [(i, j, r.choice([-2, -1, 1, 2, 3])) for i, j in {(r.randrange(nrows), r.randrange(ncols)) for _ in range(n)}]


@pytest.mark.parametrize("limit,held", [(8_000_000, 1 << 20), (40, 7), (3, 1)])
def test_cluster_and_mixed_products_match_a_plain_product(spark, monkeypatch, limit, held):
    """Whole blocks, blocks of a few clusters, and clusters and rows of more products than a block; dense and sparse clusters."""
    for name, value in (("BLOCK_PRODUCTS", limit), ("BLOCK_CELLS", held), ("FORMED", held), ("OUT_CELLS", held)):
        monkeypatch.setattr(spgemm, name, value)
    for name, value in (("SPAN_PRODUCTS", limit), ("SPAN_CELLS", held), ("SPAN_FORMED", held)):
        monkeypatch.setattr(work, name, value)
    r = random.Random(held)
    a = cells(r, 23, 30, 90)
    b = cells(r, 30, 200, 60) + [(k, 100 + j, 1) for k in range(8) for j in range(4)]
    b = list({(i, j): (i, j, v) for i, j, v in b}.values())
    ma, mb = make(spark, a, 23, 30), make(spark, b, 30, 200)
    want, stats = {}, {}
    members = layouts.variable_clusters(ma, spark.createDataFrame([(0, 0, 1), (1, 1, 4), (2, 4, 12), (3, 12, 23)], "cluster long, start long, stop long"))
    of = {x.i: x.cluster for x in members.collect()}
    for i, k, v in a:
        for x, j, w in b:
            if x == k:
                want[i, j] = want.get((i, j), 0) + v * w
                stats.setdefault(of[i], set()).add(j)
    want = {k: v for k, v in want.items() if v}
    for strategy in ("cluster", "mixed"):
        got = spgemm.spgemm(ma, mb, strategy, members=members).entries.collect()
        assert len(got) == len(want) and {(x.i, x.j): x.v for x in got} == want
    shared = {c: len({k for i, k, _ in a if of[i] == c}) for c in set(of.values())}
    got = {x.cluster: (x.csz, x.acols, x.nnz, x.min_col, x.max_col) for x in work.cluster_stats(ma, mb, members).collect()}
    assert got == {c: ([1, 3, 8, 11][c], shared[c], len(s), min(s), max(s)) for c, s in stats.items()}


def test_lanes_without_an_entry_meet_no_row(spark):
    """Row 1 has no entry in column 0, so the infinite value there is not its own, whatever pads its lane."""
    a, b = make(spark, [(0, 0, 1), (1, 1, 2)], 2, 2), make(spark, [(0, 0, float("inf")), (1, 1, 3)], 2, 2)
    members = layouts.fixed_clusters(a, 2)
    for strategy in ("cluster", "mixed"):
        got = sorted(map(tuple, spgemm.spgemm(a, b, strategy, members=members).entries.collect()))
        assert got == [(0, 0, float("inf")), (1, 1, 6.0)]


def test_cluster_products_are_not_shuffled(spark):
    a = make(spark, [(i, i % 3, 1) for i in range(40)], 40, 3)
    b = make(spark, [(k, j, 1) for k in range(3) for j in range(50)], 3, 50)
    out = spgemm.spgemm(a, b, "cluster", members=layouts.fixed_clusters(a, 8)).entries
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0] and out.agg(F.count("*")).first()[0] == 2000
