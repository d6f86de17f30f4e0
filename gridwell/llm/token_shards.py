"""Token ids of a corpus as wavelet-matrix shard files in document order, and their reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridwell.llm.blobs import read_blob, write_blob
from gridwell.llm.chunked_bpe import SpacePieces
from gridwell.llm.wavelet import pack_ranked, shard
from gridwell.plans.runtime import fresh_path, materialize, partitions, tidy

#: Ids after which a shard file ends with its batch.
SHARD_IDS = 4_000_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 16_000_000
_null_id = -(1 << 63)
_encoders: dict = {}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """(doc_ids, texts) of as many batches at a time as hold BATCH_BYTES; nulls are replaced."""
    held, size = [], 0

    def out():
        keys = np.concatenate([pc.fill_null(b.column(0), _null_id).to_numpy() for b in held])
        return keys, pa.concat_arrays([pc.fill_null(b.column(1), "").cast(pa.string()) for b in held])

    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _batches(texts: pa.StringArray, size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text and write shard files in ascending doc_id order; returns the manifest.

    The manifest has a row for each file: path, part, seq, n_tokens, n_docs; (part, seq) is the order. Null texts
    count as empty, each document ends with `end_id`, so an empty one has that id alone. Null doc_ids come first.
    Documents that share a doc_id keep an order by text. An empty table gives no files. Other columns are ignored.
    One range shuffle deals the documents; a shard is built in memory from `shard_ids` ids at most beyond one batch.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")

    @tidy
    def run(batches):
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = SpacePieces(tokenizer_path)
        coder, part = _encoders[tokenizer_path], TaskContext.get().partitionId()
        ids, names, sizes, seq, held = [], [], [], 0, 0

        def flush():
            path, own = f"{folder}/part-{part:06d}-{seq:05d}.wvm", np.concatenate(names)
            write_blob(path, pack_ranked(np.concatenate(ids), own, np.concatenate(sizes)))
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_tokens": [held], "n_docs": [len(own)]}, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

        for keys, texts in _gathered(batches):
            for a, b in _batches(texts):
                got, lengths = coder.encode(texts.slice(a, b - a), end_id)
                ids.append(got)
                sizes.append(lengths)
                names.append(keys[a:b])
                held += len(got)
                if held >= shard_ids:
                    yield flush()
                    ids, names, sizes, seq, held = [], [], [], seq + 1, 0
        if held:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(run, "path string, part int, seq int, n_tokens long, n_docs long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    start: ids of all documents before it. It is summed in two steps, over the files of a part and over the parts.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    placed = manifest.join(before, "part").select("path", (F.col("before") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("base"))

    @tidy
    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = shard(read_blob(path))
                ids = f.decode().astype("<u4")
                ends = np.cumsum(f.lengths, dtype=np.int64)
                starts = ends - f.lengths
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=f.doc_ids == _null_id), pa.array(starts + base), pa.array(f.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
