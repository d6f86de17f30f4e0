"""Wavelet files whose planes are parted in several runs."""

import numpy as np
import pytest

from gridwell.llm import wavelet


@pytest.mark.parametrize("run", [1, 7, 64, 1 << 15])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_runs_give_the_same_planes_and_ids(monkeypatch, run, n):
    monkeypatch.setattr(wavelet, "RUN_IDS", run)
    ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint16)
    want = ids
    for shift, (bit, zeros) in zip(range(15, -1, -1), wavelet._planes(ids, 16)):
        own = want >> shift & 1 == 1
        assert (bit == own).all() and zeros == n - own.sum()
        want = np.concatenate([want[~own], want[own]])
    assert (wavelet.WaveletFile(wavelet.pack(ids, np.arange(1), np.array([n]))).decode() == ids).all()
