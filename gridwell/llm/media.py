"""Media columns: FLAC bytes into checked PCM blocks with sample offsets, and text payloads as FLAC media."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwell.llm import flac
from gridwell.plans.runtime import materialize, tidy

#: Payload bytes that are coded side by side.
BATCH_BYTES = 3_000_000


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for k, s in enumerate(sizes):
        total += s
        if total >= BATCH_BYTES:
            yield a, k + 1
            a, total = k + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text, padded with 255 to a positive multiple of 576, as FLAC.

    Null texts count as empty: one block of padding. Rows, doc_ids (null too) and their repeats stay, other columns go,
    an empty table gives an empty one; no shuffle.
    """

    @tidy
    def run(batches):
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _runs([len(r) + flac.BLOCK for r in raws]):
                own = raws[a:b]
                media = flac.encode_many([r + b"\xff" * (-len(r) % flac.BLOCK or (0 if r else flac.BLOCK)) for r in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, key: str, column: str = "media", block: int = 1 << 16) -> DataFrame:
    """(key, block, first_sample, n_samples, bps, pcm) of every FLAC value of `column`, in blocks of `block` samples.

    pcm has little-endian signed samples, one byte each up to 8 bits and two above. first_sample is the offset in the
    stream, so a reader seeks by it. Null or empty media give no rows; a damaged stream raises BadFrame.
    """
    kind = dict(media.dtypes)[key]

    @tidy
    def run(batches):
        for batch in batches:
            values = [v or b"" for v in batch.column(1).to_pylist()]
            for a, b in _runs([4 * len(v) for v in values]):
                at = [k for k in range(a, b) if values[k]]
                cols = ([], [], [], [], [], [])
                for k, (info, samples) in zip(at, flac.decode_many([values[k] for k in at])):
                    wide = samples.astype("<i1" if info["bps"] <= 8 else "<i2")
                    for n, lo in enumerate(range(0, len(wide), block)):
                        part = wide[lo : lo + block]
                        for c, v in zip(cols, (batch.column(0)[k].as_py(), n, lo, len(part), info["bps"], part.tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], names=[key, "block", "first_sample", "n_samples", "bps", "pcm"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, block long, first_sample long, n_samples long, bps int, pcm binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Payload, stored form and features of every text of docs(doc_id, text), from what is read back.

    Texts are written as FLAC streams; these are read, decoded with their checksums verified, and described by their
    samples. PCM blocks are not written here: beside the streams they would double what is on disk; see `pcm_blocks`.
    Null texts count as empty, repeated rows and null ids stay, a very long text is coded in slices of frames, an empty
    table gives an empty one.
    """
    streams = materialize(text_media(docs), "media-flac", "zstd", 9)  # copies and seek tables shrink, Rice codes hardly

    @tidy
    def run(batches):
        for batch in batches:
            values = batch.column(2).to_pylist()
            for a, b in _runs([len(v) for v in values]):
                rows = []
                for v, (_, samples) in zip(values[a:b], flac.decode_many(values[a:b])):
                    s = samples.astype(np.int8)
                    payload, low = (s.view(np.uint8) ^ 0x80).tobytes(), s < 0
                    parts = [s[k : k + (1 << 20)].astype(np.int64) for k in range(0, len(s), 1 << 20)]
                    feature = f"sum={sum(int(x.sum()) for x in parts)} energy={sum(int((x * x).sum()) for x in parts)} peak={max(int(np.abs(x).max()) for x in parts)} turns={int(np.count_nonzero(low[1:] != low[:-1]))}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(v), hashlib.sha256(v).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return streams.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
