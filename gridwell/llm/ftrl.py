"""Hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridwell.llm.sample import labelled_sample
from gridwell.plans.runtime import quoted, tidy

#: log2 of the number of weights.
HASH_BITS = 20
#: Labelled rows that are fitted at most; they are the ones with the lowest hash of their text.
FIT_ROWS = 5000
#: Value of a feature is SCALE times its share of the text's features.
SCALE = 30.0
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xFF51AFD7ED558CCD)
#: Bytes that are hashed at once.
CHUNK = 1 << 20
_MASK64 = (1 << 64) - 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for one chunk."""
    out = []
    for base in (int(_MUL), pow(int(_MUL), -1, 1 << 64)):
        a = np.full(CHUNK + 1, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


#: 0 white space and control, 1 letters, digits and all beyond ASCII, 2 other signs.
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 else 2 for b in range(256)], np.uint8)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of the bytes: the sum of (byte + 1) MUL**place modulo 2**64, mixed.

    Chunk by chunk, so that memory beyond the words does not grow with the text; a word over an edge is put together.
    """
    p, inv = _tables()
    starts, hashes, length, open_kind = [], [], 0, 0
    for lo in range(0, len(buf), CHUNK):
        part = buf[lo : lo + CHUNK]
        kind = _CLASS[part]
        cut = np.flatnonzero(np.diff(kind, prepend=kind[0] ^ 3))  # every first place of a run, the chunk's too
        stop, own = np.append(cut[1:], len(part)), kind[cut] > 0
        a, b = cut[own], stop[own]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_FOLD[part].astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=total[1:])
        h, a = (total[b] - total[a]) * inv[a], a + lo
        size = int(b[-1] + lo - a[-1]) if len(a) else 0
        if len(a) and open_kind and kind[0] == open_kind:  # goes on with the last word of the chunk before
            joined = (int(hashes[-1][-1]) + pow(int(_MUL), length, 1 << 64) * int(h[0])) & _MASK64
            hashes[-1][-1], length = joined, length + int(b[0])
            a, h = a[1:], h[1:]
            size = size if len(a) else length
        starts.append(a)
        hashes.append(h)
        if not len(a) and len(starts) > 1:  # the word still open stays the last one
            starts, hashes = [*starts[:-2], starts[-2]], [*hashes[:-2], hashes[-2]]
        open_kind, length = int(kind[-1]), size
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    h ^= h >> np.uint64(31)
    return np.concatenate([*starts, np.zeros(0, np.int64)]), h * _MIX


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weight index of every word and word pair of the texts, and where each text's features start (one more at the end).

    Words are runs of letters and digits or runs of other signs, lower-cased in ASCII, digits alike.
    """
    raws = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    a, h = word_hashes(np.frombuffer(b" ".join(raws) + b" ", np.uint8))
    doc = np.searchsorted(ends, a, side="right")
    same = h[:-1] == h[1:]
    pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    pair ^= pair >> np.uint64(29)
    pair[same] = 1  # a word and itself again is one pair, whatever the word
    inside = doc[:-1] == doc[1:]
    pair, pair_doc = (pair * _MIX)[inside], doc[:-1][inside]
    shift = np.uint64(64 - HASH_BITS)
    n1, n2 = np.bincount(doc, minlength=len(texts)), np.bincount(pair_doc, minlength=len(texts))
    index = np.concatenate([h >> shift, pair >> shift]).astype(np.int64)
    order = np.argsort(np.concatenate([doc, pair_doc]), kind="stable")
    return index[order], np.concatenate([[0], np.cumsum(n1 + n2)])


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss with L1 and L2 terms."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << HASH_BITS) + 1), np.zeros((1 << HASH_BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def fit(texts: list[str], labels: list[int], epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights, the bias last. No rows: all zero."""
    model, rows = Ftrl(), []
    bias = 1 << HASH_BITS
    for k in range(0, len(texts), 200):
        index, starts = features(texts[k : k + 200])
        for j, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            at, n = np.unique(index[a:b], return_counts=True)
            rows.append((np.append(at, bias), np.append(SCALE * n / max(b - a, 1), 1.0), labels[k + j]))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            model.update(*rows[k])
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from docs(doc_id, text) and labels(doc_id, label), of `fit_rows` rows at most that `learn` allows.

    learn is a condition on doc_id; labels that it keeps out are read by nothing, counts included. The labels' shares in
    the sample are those of the rows it allows: both labels take the rows with the lowest text hash.
    """
    allowed = labels.filter(learn)
    n = {r.label: r.n for r in allowed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    whole = sum(n.values())
    limits = {y: k if whole <= fit_rows else max(1, k * fit_rows // whole) for y, k in n.items()}
    rows = labelled_sample(docs, allowed, learn, limits)
    return fit([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns and score (0 to 1) of every row of docs(text, ...).

    Null and empty texts get the bias alone. Repeated rows and null ids stay, equal texts score alike; an empty table
    gives an empty one. Whole texts count: a very long one is hashed in chunks, so memory beyond its words is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce("text", F.lit("")))

    @tidy
    def run(batches):
        w = shared.value
        for batch in batches:
            texts, lo = batch.column(len(keep)).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (size < 1_000_000 or hi == lo):
                    size, hi = size + len(texts[hi]), hi + 1
                index, starts = features(texts[lo:hi])
                run_sum = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
                n = np.maximum(np.diff(starts), 1)
                margin = SCALE * (run_sum[starts[1:]] - run_sum[starts[:-1]]) / n + w[-1]
                got = np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), pa.array(got)], names=[*keep, "score"])
                lo = hi

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())]))
