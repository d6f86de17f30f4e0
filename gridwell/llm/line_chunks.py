"""Content-defined line chunks that repeat across documents, removed after byte comparison.

A rolling hash over the hashes of a line and the one before it says whether the line ends one chunk and begins the next:
boundaries depend on nearby lines alone, so that a shift elsewhere leaves them. Chunks hold both their boundary lines, so
each has two lines at least. A passage may begin and end off the boundaries or hold none, so that from each line on, and
up to each line, the fewest lines of passage length are chunks as well: together they cover every passage whole.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from gridwell.plans.runtime import materialize, quoted, small, tidy

#: Words of a passage: from so many on it is found wherever the boundaries are.
PASSAGE_WORDS = 50
#: Bytes of the filter of repeated hashes that each task holds at most.
BLOOM_BYTES = 64 << 20
#: Places of a chunk from which they are no longer joined by a shuffle on it.
HOT_PLACES = 1000
#: Lines under the rolling hash, and the bits of it that are zero at a boundary.
_WINDOW, _MASK, _MUL = 2, 1, 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks between boundaries as (first line, line after the last); blank lines are no boundaries."""
    own = [xxhash.xxh64_intdigest(x) for x in lines]
    out, last, roll, gone = [], None, 0, pow(_MUL, _WINDOW, 1 << 64)
    for i, h in enumerate(own):
        roll = (roll * _MUL + h - (own[i - _WINDOW] * gone if i >= _WINDOW else 0)) & _M64
        if not roll >> 17 & _MASK and lines[i].strip():
            if last is not None:
                out.append((last, i + 1))
            last = i
    return out


def windows(lines: list[bytes], passage: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """The fewest lines from each line on, and up to each line, that have `passage` words.

    Each line of a passage is in one that lies inside of it: with less than `passage` words from the line to the end of
    the passage, the window that ends there holds it.
    """
    words = [len(x.split()) for x in lines]
    if sum(words) < passage:
        return []
    upto, out = [0, *itertools.accumulate(words)], set()
    for k, n in enumerate(words):
        if n >= passage:
            out.add((k, k + 1))
        elif n:
            if (b := bisect.bisect_left(upto, upto[k] + passage)) < len(upto):
                out.add((k, b))
            if (a := bisect.bisect_right(upto, upto[k + 1] - passage) - 1) >= 0:
                out.add((a, k + 1))
    return sorted(out)


def _rows(docs: DataFrame, bloom: Broadcast | None = None) -> DataFrame:
    """Every chunk: (k0, k1, k2) name its document, a and b its lines, h1 and h2 hash its bytes.

    With a filter only the chunks that it may hold, and their bytes as `raw`.
    """
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names, text_of = ["k0", "k1", "k2", "a", "b", "h1", "h2"], xxhash.xxh128_intdigest

    @tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols, raws = ([], [], [], [], [], [], []), []
                for k0, k1, k2, text in zip(*(part.column(k).to_pylist() for k in range(4))):
                    raw = memoryview(text.encode())
                    lines = raw.obj.split(b"\n")
                    at = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
                    for a, b in sorted({*chunks(lines), *windows(lines)}):
                        own = raw[at[a] : at[b] - 1]
                        both = text_of(own)
                        for c, v in zip(cols, (k0, k1, k2, a, b, (both >> 64) - (1 << 63), (both & _M64) - (1 << 63))):
                            c.append(v)
                        if bloom is not None:
                            raws.append(own)
                if bloom is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                    continue
                keep = np.flatnonzero(bloom.value.has(np.array(cols[5], np.int64), np.array(cols[6], np.int64))).tolist()
                arrays = [pa.array([c[x] for x in keep], k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([str(raws[x], "utf-8") for x in keep], pa.string())], names=[*names, "raw"])

    return docs.select("k0", "k1", "k2", "text").mapInArrow(run, "k0 int, k1 long, k2 long, a int, b int, h1 long, h2 long" + ", raw string" * (bloom is not None))


class Bloom:
    """Blocked Bloom filter of 128-bit hashes: the first half names a block, three slices of the second a bit each."""

    BLOCK = 19  # log2 of a block's bits

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @classmethod
    def bits(cls, h2: np.ndarray) -> np.ndarray:
        return np.stack([h2.view(np.uint64) >> np.uint64(k * cls.BLOCK) & np.uint64((1 << cls.BLOCK) - 1) for k in range(3)]).astype(np.int64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(h1):
            return np.zeros(0, bool)
        block, at = h1 & (len(self.blocks) - 1), self.bits(h2)
        return np.logical_and.reduce([self.blocks[block, b >> 3] >> (b & 7).astype(np.uint8) & 1 for b in at]).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame) -> Bloom:
        """About 16 bits a hash, BLOOM_BYTES at most. Beyond that more chunks pass it; the result stays the same."""
        n = 1
        while n << cls.BLOCK < 16 * hashes.count() and (2 * n << cls.BLOCK) // 8 <= BLOOM_BYTES:
            n *= 2

        def build(group: pa.Table) -> pa.Table:
            bits = np.zeros(1 << cls.BLOCK, bool)
            bits[cls.bits(group.column("h2").to_numpy()).ravel()] = True
            return pa.table({"block": group.column("block").slice(0, 1), "raw": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        blocks = np.zeros((n, (1 << cls.BLOCK) // 8), np.uint8)
        named = hashes.select(F.col("h1").bitwiseAND(F.lit(n - 1)).cast("int").alias("block"), "h2")
        for block, raw in named.groupBy("block").applyInArrow(build, "block int, raw binary").toLocalIterator():
            blocks[block] = np.frombuffer(raw, np.uint8)
        return cls(blocks)


def _keys() -> list:
    """What names a document: whether its id is null, its id and its text's hash."""
    return [F.col("doc_id").isNull().cast("int").alias("k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64("text").alias("k2")]


def repeated(docs: DataFrame) -> DataFrame:
    """(k0, k1, k2, spans): line spans of each document that repeat a chunk seen in an earlier place, compared byte by byte.

    Places are ordered by doc_id (null last), text hash and line. Hash counts find the chunks that may repeat; a bounded
    Bloom filter of them goes to the tasks, so that only bytes of such chunks are shuffled. They are grouped by the bytes
    themselves with partial aggregation; chunks of HOT_PLACES places or more are then joined by broadcast.
    """
    keyed = docs.select(*_keys(), "text").filter("text is not null and text <> ''")
    once = _rows(keyed)
    twice = materialize(once.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "line-hashes")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(twice))
    held = materialize(_rows(keyed, bloom), "line-chunks")
    place, key = F.struct("k0", "k1", "k2", "a"), ["h1", "h2", "raw"]
    first = materialize(held.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "line-firsts")
    hot, rest = first.filter(F.col("n") >= HOT_PLACES), first.filter(F.col("n") < HOT_PLACES)
    if hot.limit(1).count():
        hot = small(hot)
        joined = held.join(hot, key).unionByName(held.join(hot.select(*key), key, "left_anti").join(rest, key))
    else:
        joined = held.join(rest, key)
    return joined.filter(place != F.col("first")).groupBy("k0", "k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the spans, and how many lines went."""
    lines, gone = text.split("\n"), {k for a, b in spans for k in range(a, b)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def dedup_lines(docs: DataFrame, count: str = "lines_removed") -> DataFrame:
    """docs with repeated chunks cut from `text`, and `count`, how many lines went; every row and other column stays.

    The first place of a chunk keeps it; where it repeats into itself, one period stays. Null and empty texts stay as they
    are (0 lines removed). Rows that agree in doc_id (null or not) and text are one document: all of them keep or lose the
    same lines. A text of which every line repeats becomes empty. An empty table gives an empty one. Line separators other
    than \\n are part of their line. Very long texts are one row of work, and each of its lines two chunks more at most.
    A column that is already called `count` is replaced; other names may be anything.
    """
    gone = materialize(repeated(docs), "line-spans")
    names = docs.columns
    keyed = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), *_keys())
    joined = keyed.join(small(gone), ["k0", "k1", "k2"], "left").select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)], "spans")
    at = names.index("text")
    kept = [k for k, c in enumerate(names) if c != count]

    @tidy
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts, spans, n = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), []
                for k, s in enumerate(spans):
                    lost = 0
                    if s and texts[k]:
                        texts[k], lost = cut(texts[k], [(x["a"], x["b"]) for x in s])
                    n.append(lost)
                cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*[names[k] for k in kept], count])

    return joined.mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in kept), T.StructField(count, T.LongType())]))
