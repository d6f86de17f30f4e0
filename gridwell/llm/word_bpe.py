"""BPE by a table of distinct words: words are split in blocks of documents, every distinct word of the corpus is encoded
once, and its ids, joined with the vocabulary for their pieces, join back to the documents by position.

Words are runs without white space, which the tokenizer never joins, less the signs that close them. What is shuffled are
the distinct words of each block, not their occurrences: documents keep numbers into their block's words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridwell.llm.chunked_bpe import tokenizer
from gridwell.plans.runtime import bound_batches, bucketed, give_back, partitions, tidy

_vocabularies: dict = {}
#: White space of the tokenizer besides the space and the line end, in RE2.
_SPACE = r"[\t\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text of a block at most, but for a longer text; bytes that are split at once, but for a longer word; word
#: occurrences that are put together at once.
BLOCK_BYTES, SPLIT_BYTES, SLICE_WORDS = 32 << 20, 4 << 20, 1 << 17
#: Where a long text may be cut.
_GAP = re.compile(rb"[ \n]")
#: Words that go to the tokenizer at once.
ENCODE_WORDS = 20_000
#: A word that ends in ASCII signs after a letter: the tokenizer cuts there.
_CLOSED = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.S)
#: Words whose letters the tokenizer lowers one by one, as str.lower does.
_LATIN = re.compile(r"[\x00-\u012f\u0131-\u024f]*")


def bases(word: str) -> tuple[str, str]:
    """(word, signs) that encode one after the other as the word does; no signs for most words, and case is folded where
    the tokenizer folds it. Words that may hold a special token stay as they are."""
    if "<|" in word:
        return word, ""
    m = _CLOSED.fullmatch(word)
    base, signs = m.groups() if m and m[1][-1].lower().isalpha() else (word, "")  # some letters lower to a letter and a mark
    return (base.lower() if _LATIN.fullmatch(base) else base), signs


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in order). Null texts have none."""
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
    odd = pc.match_substring_regex(texts, _SPACE)
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(texts.filter(odd), _SPACE, " "))
    split = pc.split_pattern(texts, " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    word = pc.greater(pc.binary_length(flat), 0)  # gaps between white space and white space are none
    upto = np.append(0, np.cumsum(word.to_numpy(zero_copy_only=False)))[offsets - offsets[0]]
    return np.diff(upto), flat.filter(word)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, texts) of as many rows at a time as hold SPLIT_BYTES, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = min(max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPLIT_BYTES - size, side="right"))), batch.num_rows)
            held.append(batch.slice(a, b - a))
            size += int(ends[b - 1] - (ends[a - 1] if a else 0))
            a = b
            if size >= SPLIT_BYTES or a < batch.num_rows:
                yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """texts, or SPLIT_BYTES at a time of the one long text that they are, cut at spaces and line ends."""
    raw = texts[0].as_buffer() if len(texts) == 1 and texts[0].is_valid else b""
    if len(raw) <= SPLIT_BYTES:
        yield texts
        return
    view, a = memoryview(raw), 0
    while a < len(view):
        gap = _GAP.search(view, a + SPLIT_BYTES)
        b = gap.end() if gap else len(view)
        yield pa.array([view[a:b].tobytes()], pa.large_binary()).cast(pa.large_string())
        a = b


class _Block:
    """Documents of a block as numbers of its distinct words, which count in the order they come."""

    def __init__(self):
        self.number, self.ids, self.sizes, self.at, self.bytes = {}, [], [], [], 0

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, numbers of all words in order)."""
        sizes, flat = split_words(texts)
        if not len(flat):
            return sizes, np.zeros(0, np.int32)
        numbered = flat.dictionary_encode()
        del flat
        number, first, signs = self.number, [], []
        for w in numbered.dictionary.to_pylist():
            base, after = bases(w)
            first.append(number.setdefault(base, len(number)))
            signs.append(number.setdefault(after, len(number)) if after else -1)
        first, signs = np.array(first, np.int32), np.array(signs, np.int32)
        word = numbered.indices.to_numpy(zero_copy_only=False)
        closed = signs[word] >= 0
        ends = np.cumsum(closed + np.int64(1))
        at = np.repeat(first[word], closed + np.int8(1))
        at[ends[closed] - 1] = signs[word[closed]]
        return np.diff(np.append(0, ends)[np.append(0, np.cumsum(sizes))]), at

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        parts = [self._numbers(piece) for piece in _pieces(texts)]
        self.ids.append(ids)
        self.sizes.append(np.sum([sizes for sizes, _ in parts], axis=0).astype(np.int32))  # one text's pieces, or all texts
        self.at += [at for _, at in parts]
        self.bytes += texts.nbytes

    def row(self, block: int) -> pa.RecordBatch:
        count = np.zeros(len(self.number), np.int64)
        for at in self.at:
            count += np.bincount(at, minlength=len(count))
        rank = np.argsort(-count, kind="stable")
        words = pa.array(list(self.number), pa.string()).take(pa.array(rank))
        self.number = {}
        place = np.empty(len(rank), "<u4")
        place[rank] = np.arange(len(rank), dtype="<u4")
        planes, a = np.empty((4, int(count.sum())), np.uint8), 0
        for at in self.at:
            planes[:, a : a + len(at)] = place[at].view(np.uint8).reshape(-1, 4).T
            a += len(at)
        self.at = []
        packed = pa.Codec("zstd", compression_level=6).compress(pa.py_buffer(planes), asbytes=True)
        del planes
        row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        values = [pa.array([block], pa.int64()), row(pa.concat_arrays(self.ids)), row(pa.array(np.concatenate(self.sizes))), pa.array([packed], pa.binary()), row(words)]
        return pa.RecordBatch.from_arrays(values, names=["block", "doc_ids", "sizes", "at", "words"])


def _block_rows(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """The rows of split_blocks for the documents of one partition. Texts are held SPLIT_BYTES at a time."""
    seq, block = 0, _Block()
    for ids, texts in _gathered(batches):
        if block.ids and block.bytes + texts.nbytes > BLOCK_BYTES:
            yield block.row(part << 32 | seq)
            seq, block = seq + 1, _Block()
        block.add(ids, texts)
    if block.ids:
        yield block.row(part << 32 | seq)


def split_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, sizes, at, words): a row for each block of documents, written in buckets by block.

    words are the block's distinct words, the frequent ones first; at has the number of each word occurrence in them, in
    four planes of bytes, sizes how many each document has.
    """

    @tidy
    def run(batches):
        yield from _block_rows(batches, TaskContext.get().partitionId())

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, at binary, words array<string>")
    return bucketed(rows, "block", "bpe_blocks")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The rows of encode_words for (block, k, word) in the order of words."""
    tok, last, bytes_of = tokenizer(path), None, b""
    for batch in batches:
        for a in range(0, batch.num_rows, ENCODE_WORDS):
            part = batch.slice(a, ENCODE_WORDS)
            numbered = part.column(2).dictionary_encode()
            own = numbered.dictionary.to_pylist()
            fresh = own[1:] if own[0] == last else own  # the word of the batch before may go on
            got = [np.array(e.ids, "<i4").tobytes() for e in tok.encode_batch_fast(fresh, add_special_tokens=False)]
            got = [bytes_of, *got] if own[0] == last else got
            last, bytes_of = own[-1], got[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary()).take(numbered.indices)], names=["of", "k", "ids"])


def encode_words(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(of, k, ids) of words(block, k, word): the ids of each word as little-endian 32-bit integers.

    One shuffle brings all rows of a word together, in order, so that each distinct word is encoded once.
    """

    @tidy
    def run(batches):
        yield from _encoded(batches, tokenizer_path)

    dealt = words.select("block", "k", "word").repartition(partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "of long, k int, ids binary")


def _vocabulary(path: str) -> tuple[pa.Array, pa.Array]:
    """(pieces, decimal numbers) by id, of this worker; ids without a piece are empty."""
    if path not in _vocabularies:
        by_id = {i: p for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
        top = max(by_id, default=-1) + 1
        _vocabularies[path] = pa.array([by_id.get(i, "") for i in range(top)], pa.large_string()), pa.array([str(i) for i in range(top)], pa.large_string())
    return _vocabularies[path]


def _assembled(block: pa.Table, words: pa.Table, path: str) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]:
    """(doc_ids, number of ids, ids joined by a space, decoded text) of documents of a block, SLICE_WORDS words at a time.

    words(k, ids) has the ids of the block's words by number. Ids join the vocabulary once for each word of the block,
    and what they give joins the occurrences by position.
    """
    get = lambda name: block.column(name).combine_chunks()
    doc_ids, sizes, space = get("doc_ids").flatten(), get("sizes").flatten().to_numpy().astype(np.int64), pa.scalar(" ", pa.large_string())
    ends = np.append(0, np.cumsum(sizes))
    total = int(ends[-1])
    planes = np.zeros((4, 0), np.uint8)
    if total:
        planes = np.frombuffer(pa.decompress(get("at")[0].as_py(), decompressed_size=4 * total, codec="zstd", asbytes=True), np.uint8).reshape(4, total)
    order = pa.array(np.argsort(words.column("k").to_numpy()))
    raw = words.column("ids").combine_chunks().cast(pa.large_binary()).take(order)
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = pa.array(np.frombuffer(raw.buffers()[2] or b"", "<i4", int(n.sum())))  # take() begins its buffer anew
    cuts = pa.array(np.append(0, np.cumsum(n)), pa.int32())
    pieces, numbers = (pc.binary_join(pa.ListArray.from_arrays(cuts, v.take(flat)), space) for v in _vocabulary(path))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, side="right")) - 1)
        own = np.ascontiguousarray(planes[:, ends[a] : ends[b]].T).view("<u4").ravel().astype(np.int64)
        each = n[own] if len(own) else own
        kept, inside = each > 0, ends[a : b + 1] - ends[a]  # words that the tokenizer drops whole leave no gap
        starts, take = pa.array(np.append(0, np.cumsum(kept))[inside], pa.int32()), pa.array(own[kept])
        joined = [pc.binary_join(pa.ListArray.from_arrays(starts, t.take(take)), space) for t in (numbers, pieces)]
        yield doc_ids.slice(a, b - a), np.diff(np.append(0, np.cumsum(each))[inside]), *joined
        a = b


def _per_block(docs: DataFrame, tokenizer_path: str, rows, schema: pa.Schema, sql: str) -> DataFrame:
    """rows(...) of every slice of every block and the ids of its words."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        parts = [pa.Table.from_arrays(rows(*x), schema=schema) for x in _assembled(block, words, tokenizer_path)]
        give_back()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    blocks = split_blocks(docs)
    found = encode_words(blocks.select("block", F.posexplode("words").alias("k", "word")), tokenizer_path)
    n = partitions(docs.sparkSession)
    mine = blocks.select("block", "doc_ids", "sizes", "at")  # buckets are read where they are, only words move
    return mine.groupBy("block").cogroup(found.repartition(n, "of").groupBy("of")).applyInArrow(run, sql)


def _sha256(texts: pa.Array) -> list[str]:
    """Digests of a large_string array's values, read in place."""
    ends = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset).tolist()
    raw = memoryview(texts.buffers()[2] or b"")
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array), decoded of every document. Null texts count as empty: no ids, empty decoded text.

    Repeated rows give repeated rows, null doc_ids stay null, other columns are ignored; a very long text is a block of
    its own, an empty table gives an empty one. Two shuffles of the blocks' distinct words, none of documents.
    """

    def rows(doc_ids: pa.Array, count: np.ndarray, ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
        flat = pc.split_pattern(ids.filter(pa.array(count > 0)), " ").flatten().cast(pa.int32())
        return [doc_ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), flat), decoded.cast(pa.string())]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _per_block(docs, tokenizer_path, rows, schema, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the same table, without handing ids over to the JVM."""

    def rows(doc_ids: pa.Array, count: np.ndarray, ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
        return [doc_ids, pa.array(count, pa.int64()), pa.array(_sha256(ids), pa.string()), pa.array(_sha256(decoded), pa.string())]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _per_block(docs, tokenizer_path, rows, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
