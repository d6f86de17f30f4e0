"""The clustering queries take all pairs of every bucket."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridwell import catalog
from gridwell.operators import cluster, lsh
from gridwell.plans import fixtures

ROWS = 300


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """300 near copies and two texts like no other. Most buckets of near copies have over 256 rows, where a row met only its
    next 16."""
    folder = tmp_path_factory.mktemp("near")
    base = " ".join(f"w{k}" for k in range(60))
    own = [f"{base} only{i}" for i in range(ROWS)] + ["aa bb cc", "dd ee ff"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(own)), pa.int64()), "text": own}), folder / "documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def expected(spark, documents):
    """Roots by the greedy rule over every pair of rows that share a band."""
    sig = {x.i: np.array(x.sig) for x in catalog._sigs(spark, documents).collect()}
    rows = {x.i: set(x.cols) for x in cluster.row_sets(fixtures.document_tokens(spark, documents)).collect()}
    pairs = []
    for i in sig:
        for j in range(i + 1, len(sig)):
            equal = sig[i] == sig[j]
            if equal.reshape(catalog.BANDS, -1).all(1).any():
                pairs.append((i, j, equal.sum() / catalog.K))
    assert len(pairs) > 30_000
    root = cluster.agglomerate(pairs, rows, catalog.CLUSTER)
    return {i: root.get(i, i) for i in sig}


def test_hc_fast_takes_all_pairs(spark, documents, expected):
    assert {x.i: x.root for x in catalog.QUERIES["hc_fast"](spark, documents).collect()} == expected


def test_hc_linked_and_its_sql_cut_no_bucket(spark, documents, monkeypatch):
    limits, formed = [], lsh.bucket_pairs
    monkeypatch.setattr(lsh, "bucket_pairs", lambda banded, limit=lsh.BUCKET_LIMIT, *rest: limits.append(limit) or formed(banded, limit, *rest))
    got = [tuple(x) for x in catalog.QUERIES["hc_linked"](spark, documents).collect()]
    assert not [x for x in limits if x is not None] and "row_number" not in catalog.ORACLE_SQL["hc_linked"]
    con = duckdb.connect()
    con.sql(f"create view documents as from '{documents}/documents.parquet'")
    assert got == con.sql(catalog.ORACLE_SQL["hc_linked"]).fetchall() == [(ROWS + 2, 0, 0, 2)]


def test_hc_permutation_follows_all_pairs(spark, documents, expected):
    order = sorted(expected, key=lambda i: (expected[i], i))
    assert {x.new_row: x.old_row for x in catalog.QUERIES["hc_permutation"](spark, documents).collect()} == dict(enumerate(order))


def test_no_cap_unless_asked_for(spark, documents):
    banded = lsh.bands(catalog._sigs(spark, documents), catalog.K, catalog.BANDS)
    assert lsh.bucket_pairs(banded).count() == lsh.bucket_pairs(banded, None).count() > lsh.bucket_pairs(banded, lsh.BUCKET_LIMIT).count()
