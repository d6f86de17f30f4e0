"""Greedy clustering in bounded memory, and scores by blocks of signatures."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwell.operators import cluster, lsh
from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import by_kind


def plain(pairs, rows, cap):
    """The greedy rule on plain lists: look at all waiting pairs, take the best, tell every member."""
    root = {x: x for i, j, _ in pairs for x in (i, j)}
    waiting, seen, closed = [(s, i, j) for i, j, s in pairs], {(i, j) for i, j, _ in pairs}, set()
    size = lambda r: sum(x == r for x in root.values())
    while waiting:
        best = max(waiting)
        waiting.remove(best)
        _, i, j = best
        a, b = root[i], root[j]
        if a == b or a in closed or b in closed:
            continue
        if (a, b) == (i, j):
            into, gone = (b, a) if size(b) > size(a) else (a, b)
            root = {x: into if r == gone else r for x, r in root.items()}
            if size(into) >= cap:
                closed.add(into)
        elif (min(a, b), max(a, b)) not in seen:
            a, b = min(a, b), max(a, b)
            seen.add((a, b))
            union = rows.get(a, set()) | rows.get(b, set())
            waiting.append((len(rows.get(a, set()) & rows.get(b, set())) / len(union) if union else 0.0, a, b))
    return root


def cases(count, most):
    for seed in range(count):
        r = random.Random(seed)
        n = r.randint(2, most)
        rows = {i: {r.randrange(8) for _ in range(r.randrange(6))} for i in range(n)}
        pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 3 * n))) if a != b})
        yield r, n, rows, [(a, b, r.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for a, b in pairs]


@pytest.mark.parametrize("strategy", cluster.BOOKS)
def test_books_match_the_plain_rule(strategy, monkeypatch):
    monkeypatch.setattr(cluster._Runs, "MOST", 3)
    for r, _, rows, scored in cases(80, 40):
        cap = r.choice([2, 3, 4, 8])
        assert cluster.STRATEGIES[strategy](scored, rows, cap) == plain(scored, rows, cap)


@pytest.mark.parametrize("strategy", cluster.BOOKS)
def test_hierarchical_matches_the_plain_rule(spark, strategy):
    for _, n, rows, scored in cases(3, 60):
        m = Matrix(spark.createDataFrame([(i, j, 1.0) for i, cols in rows.items() for j in cols], "i long, j long, v double"), n + 2, 8)
        got = dict(map(tuple, cluster.hierarchical(m, spark.createDataFrame(scored, "i long, j long, score double"), 4, strategy).collect()))
        assert got == {i: i for i in range(n + 2)} | plain(scored, rows, 4)


def test_a_component_is_not_held_in_memory():
    """4 million columns and 400,000 pairs: as Python sets and tuples over 200 MB."""
    n, width, pairs = 1000, 4000, 400_000
    i, j = np.triu_indices(n, 1)
    i, j = i[:pairs].astype(np.int64), j[:pairs].astype(np.int64)

    def batch(kind, size, **columns):
        own = {"part": pa.array(np.zeros(size, np.int64)), "kind": pa.array(np.full(size, kind, np.int32))}
        return pa.RecordBatch.from_pydict(own | columns)

    def batches():
        for a in range(n):
            yield batch(0, 1, i=pa.array([a]), cols=pa.array([np.arange(a, a + width, dtype=np.int32)]))
        for kind, sign in ((1, 1), (2, -1)):
            at = np.arange(pairs) if kind == 1 else np.arange(pairs)[::-1]
            for a in range(0, pairs, 1000):
                own = at[a : a + 1000]
                yield batch(kind, 1000, s=pa.array(np.full(1000, -0.5)), i=pa.array(sign * i[own]), j=pa.array(sign * j[own]))

    tracemalloc.start()
    [(_, held)] = ((part, cluster._component(held, 8, "heap")) for part, held in by_kind(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held.num_rows == n and peak < 30e6


@pytest.mark.parametrize("ncols", [100, 1 << 40])
def test_scores_by_blocks_of_signatures(spark, monkeypatch, ncols):
    monkeypatch.setattr(lsh, "SCORE_ROWS", 7)
    r = random.Random(3)
    cells = {(i, r.randrange(min(ncols, 30))) for i in range(40) for _ in range(i % 5 * 3)}  # every fifth row is empty
    m = Matrix(spark.createDataFrame([(i, j, 1.0) for i, j in cells], "i long, j long, v double"), 40, ncols)
    sigs = lsh.signatures(m, 16, 5).cache()
    pairs = sigs.select("i").crossJoin(sigs.select(F.col("i").alias("j"))).filter("i < j")
    own = dict((x.i, x.sig) for x in sigs.collect())
    want = {(i, j): sum(x == y for x, y in zip(own[i], own[j])) / 16 for i in range(40) for j in range(i + 1, 40)}
    assert {(x.i, x.j): x.score for x in lsh._scored(m, sigs, pairs, 16, 5).collect()} == want
