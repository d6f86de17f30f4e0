"""Shards whose ids are numbered by falling count, the rare ones in a second matrix."""

import numpy as np
import public_tokenizers
import pytest

from gridwell.llm import token_shards, wavelet
from gridwell.llm.blobs import read_blob


def skewed(n, size, wide=np.uint16):
    r = np.random.default_rng(n)
    return (np.minimum(r.zipf(1.3, n), size) * (7 if wide is np.uint16 else 70_001)).astype(wide)


SHARDS = [skewed(0, 1), skewed(1, 1), np.full(1000, 65535, np.uint16), np.arange(2, dtype=np.uint16), np.repeat(np.arange(3, dtype=np.uint16), [500, 1, 1]), np.arange(256, dtype=np.uint16), np.arange(257, dtype=np.uint16), np.repeat(np.arange(65536, dtype=np.uint16), 2), skewed(70_000, 9000), skewed(3000, 50, np.uint32)]


@pytest.mark.parametrize("run", [7, 1 << 15])
@pytest.mark.parametrize("k", range(len(SHARDS)))
def test_ranked_round_trip_and_lookup(monkeypatch, run, k):
    ids = SHARDS[k]
    monkeypatch.setattr(wavelet, "RUN_IDS", run if len(ids) < 5000 else 1 << 12)
    f = wavelet.shard(wavelet.pack_ranked(ids, np.array([4, -9]), np.array([len(ids), 0])))
    assert isinstance(f, wavelet.RankedFile) and f.n == len(ids) and f.n_docs == 2
    assert (f.decode() == ids).all() and f.doc_ids.tolist() == [4, -9] and f.lengths.tolist() == [len(ids), 0]
    counts = np.unique(ids, return_counts=True)
    by_count = counts[0][np.argsort(-counts[1], kind="stable")].tolist()
    lo, hi = len(ids) // 3, len(ids) * 2 // 3
    for t in {*by_count[:2], *by_count[len(by_count) // 2 :][:2], *by_count[-2:]}:
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at) and f.count(t, lo, hi) == np.count_nonzero(ids[lo:hi] == t)
        for j in {0, len(at) // 2, len(at) - 1}:
            assert f.select(t, j) == at[j] and f.access(int(at[j])) == t
        with pytest.raises(IndexError):
            f.select(t, len(at))
    gone = next(t for t in range(1 << 17) if t not in set(by_count))
    assert f.count(gone) == 0
    with pytest.raises(IndexError):
        f.select(gone, 0)
    with pytest.raises(IndexError):
        f.access(len(ids))


def test_frequent_ids_cross_few_planes_and_old_files_are_read():
    ids = skewed(100_000, 9000)
    f = wavelet.shard(wavelet.pack_ranked(ids, np.zeros(1), np.array([len(ids)])))
    old = wavelet.shard(wavelet.pack(ids, np.zeros(1), np.array([len(ids)])))
    assert (old.decode() == f.decode()).all()
    assert 3 * (f.first.levels * f.n + f.second.levels * f.second.n) < 2 * old.levels * old.n


@pytest.mark.parametrize("seed", range(5))
def test_levels_are_the_cheapest(seed):
    counts = np.sort(np.random.default_rng(seed).zipf(1.2 + seed / 5, 50 * 3**seed).clip(max=10_000))[::-1]
    first, second = wavelet._levels(counts)
    size, total = len(counts), int(counts.sum())
    cost = lambda k, own: total * k + (int(counts[(1 << k) - 1 :].sum()) * (own + 1) if own else 0)
    assert (size <= 1 << first) if second == 0 else (size - (1 << first) + 1 <= 1 << second)
    assert cost(first, second) <= total * (size - 1).bit_length()


def test_op3_writes_ranked_files(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog " * k) for k in range(40)], "doc_id long, text string")
    made = token_shards.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=200)
    files = [wavelet.shard(read_blob(x.path)) for x in made.orderBy("part", "seq").collect()]
    assert all(isinstance(f, wavelet.RankedFile) for f in files) and sum(f.n_docs for f in files) == 40
    assert sum(f.first.levels + f.second.levels for f in files) <= 5 * len(files)
