"""The sorted product: no products are shuffled, rows come in order."""

import random

import pytest

from gridwell.operators import spgemm
from gridwell.operators.matrix import Matrix


def plain(a, b):
    out = {}
    for i, k, v in a:
        for r, j, w in b:
            if r == k:
                out[i, j] = out.get((i, j), 0.0) + v * w
    return out


@pytest.mark.parametrize("block,cells,flush", [(8_000_000, 1 << 22, 1 << 21), (60, 40, 7), (12, 1, 1)])
def test_sorted_products(spark, monkeypatch, block, cells, flush):
    """With duplicates, cancelled cells, rows of B that are missing, and rows of A over a block's products."""
    monkeypatch.setattr(spgemm, "BLOCK_PRODUCTS", block)
    r = random.Random(4)
    a = [(r.randrange(30), r.randrange(20), float(r.choice([-1, 1, 2]))) for _ in range(120)]
    b = [(r.randrange(15), r.randrange(25), float(r.choice([-1, 1, 2]))) for _ in range(90)]
    make = lambda cells, n, m: Matrix(spark.createDataFrame(cells, "i long, j long, v double"), n, m)
    c = spgemm.spgemm(make(a, 30, 20), make(b, 20, 25), "sorted")
    got = [[(x.i, x.j, x.v) for x in part] for part in c.entries.rdd.glom().collect()]
    flat = [x for part in got for x in part]
    assert {(i, j): v for i, j, v in flat} == plain(a, b) and len(flat) == len(plain(a, b))
    assert all(part == sorted(part) for part in got)
    held = [{x[0] for x in part} for part in got if part]
    assert sum(map(len, held)) == len(set().union(*held))
    monkeypatch.setattr(spgemm, "BLOCK_CELLS", cells)
    monkeypatch.setattr(spgemm, "FORMED", flush)
    assert spgemm.spgemm(make(a, 30, 20), make([], 20, 25), "sorted").entries.count() == 0
    text = c.entries._jdf.queryExecution().toString()
    assert block < 8_000_000 or "partial_sum" not in text  # nothing is summed after a shuffle of products


def test_blocks_in_slices(monkeypatch):
    """The task's own function, a few products and cells at a time."""
    import pyarrow as pa

    monkeypatch.setattr(spgemm, "BLOCK_CELLS", 4)
    monkeypatch.setattr(spgemm, "FORMED", 2)
    monkeypatch.setattr(spgemm, "OUT_CELLS", 1)
    rows = {"part": [0] * 4, "kind": [0, 0, 1, 1], "id": [3, 4, 0, 2], "cols": [[0, 2, 9], [2], [5, 7, 8], [7]], "vals": [[1.0, 2.0, 3.0], [4.0], [1.0, 1.0, 1.0], [-0.5]]}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in rows.items()})
    got = [tuple(b.column(c)[0].as_py() for c in range(3)) for b in spgemm._multiply([batch.slice(0, 3), batch.slice(3)])]
    assert got == [(3, 5, 1.0), (3, 7, 0.0), (3, 8, 1.0), (4, 7, -2.0)]
