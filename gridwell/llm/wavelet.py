"""Wavelet matrix file: bit-planes in zstd blocks with rank directories; access, count and occurrences from the file.

A ranked file numbers its ids by falling count and keeps the rare ones in a second matrix, so that most ids cross few planes.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVM1"
#: Bits in a compressed block of a bit-plane.
BLOCK_BITS = 1 << 16
#: Ids that are parted at once, so that they stay in the processor's cache.
RUN_IDS = 1 << 15
_HEAD = struct.Struct("<4sBIQQ")
RANKED = b"WVR1"
_RANKED = struct.Struct("<4sBBIQQ")


def _planes(ids: np.ndarray, levels: int):
    """Bit-planes from the most significant bit on; each level is stably parted by the bits above it, RUN_IDS at a time."""
    for shift in range(levels - 1, -1, -1):
        bit = (ids & ids.dtype.type(1 << shift)) != 0
        zeros = len(ids) - int(np.count_nonzero(bit))
        out, a, b = np.empty_like(ids), 0, zeros
        for k in range(0, len(ids), RUN_IDS):
            one, own = bit[k : k + RUN_IDS], ids[k : k + RUN_IDS]
            at, off = np.flatnonzero(one), np.flatnonzero(~one)
            own.take(off, out=out[a : a + len(off)], mode="clip")
            own.take(at, out=out[b : b + len(at)], mode="clip")
            a, b = a + len(off), b + len(at)
        yield bit, zeros
        ids = out


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, levels: int = 16) -> bytes:
    """The file of one shard. ids: unsigned, below 2**levels; lengths: ids of each document, doc_ids int64."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16 if levels <= 16 else np.uint32)
    comp = zstandard.ZstdCompressor(level=1)
    parts = [comp.compress(np.asarray(doc_ids, "<i8").tobytes()), comp.compress(np.asarray(lengths, "<u4").tobytes())]
    index, body, step = [], [], BLOCK_BITS // 8
    for bit, zeros in _planes(ids, levels):
        bits = np.packbits(bit)
        blocks = [comp.compress(bits[a : a + step].tobytes()) for a in range(0, len(bits), step)]
        ones = [int(np.bitwise_count(bits[a : a + step]).sum()) for a in range(0, len(bits), step)]
        index.append(struct.pack("<Q", zeros) + np.array([len(b) for b in blocks], "<u4").tobytes() + np.array(np.concatenate([[0], np.cumsum(ones)]), "<u8").tobytes())
        body.append(b"".join(blocks))
    head = _HEAD.pack(MAGIC, levels, BLOCK_BITS, len(ids), len(doc_ids)) + struct.pack("<QQ", *map(len, parts))
    return b"".join([head, *parts, *index, *body])


class WaveletFile:
    """One shard, read from its bytes; blocks are decompressed as they are asked for."""

    def __init__(self, data: bytes):
        magic, self.levels, self.block_bits, self.n, self.n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        a, b = struct.unpack_from("<QQ", data, _HEAD.size)
        at = _HEAD.size + 16
        undo = zstandard.ZstdDecompressor()
        self.doc_ids = np.frombuffer(undo.decompress(data[at : at + a]) if self.n_docs else b"", "<i8")
        self.lengths = np.frombuffer(undo.decompress(data[at + a : at + a + b]) if self.n_docs else b"", "<u4")
        at += a + b
        blocks = -(-self.n // self.block_bits)
        self.zeros, self.sizes, self.ranks = [], [], []
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            self.sizes.append(np.frombuffer(data, "<u4", blocks, at + 8).astype(np.int64))
            self.ranks.append(np.frombuffer(data, "<u8", blocks + 1, at + 8 + 4 * blocks).astype(np.int64))
            at += 8 + 4 * blocks + 8 * (blocks + 1)
        self.starts = []
        for sizes in self.sizes:
            self.starts.append(at + np.concatenate([[0], np.cumsum(sizes)]))
            at += int(sizes.sum())
        self.data, self.undo = data, undo
        self.block = lru_cache(maxsize=256)(self._block)

    def _block(self, level: int, k: int) -> np.ndarray:
        a, b = self.starts[level][k], self.starts[level][k + 1]
        return np.frombuffer(self.undo.decompress(self.data[int(a) : int(b)]), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, self.block_bits)
        return int(self.block(level, k)[r >> 3] >> (7 - (r & 7))) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, r = divmod(i, self.block_bits)
        if r == 0:
            return int(self.ranks[level][k])
        bits = self.block(level, k)
        ones = int(np.bitwise_count(bits[: r >> 3]).sum())
        if r & 7:
            ones += int(bits[r >> 3] >> (8 - (r & 7))).bit_count()
        return int(self.ranks[level][k]) + ones

    def _select(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level] if bit else np.minimum(np.arange(len(self.ranks[level])) * self.block_bits, self.n) - self.ranks[level]
        k = int(np.searchsorted(ranks, j, side="right")) - 1
        bits = np.unpackbits(self.block(level, k))[: self.n - k * self.block_bits]
        return k * self.block_bits + int(np.flatnonzero(bits == bit)[j - int(ranks[k])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for level in range(self.levels - 1, -1, -1):
            i = self._select(level, 1, i - self.zeros[level]) if token >> (self.levels - 1 - level) & 1 else self._select(level, 0, i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the partings are undone from the last plane to the first."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            raw = b"".join(self.undo.decompress(self.data[int(a) : int(b)]) for a, b in zip(self.starts[level][:-1], self.starts[level][1:]))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            out, a, b, one = np.empty_like(ids), 0, self.zeros[level], ids.dtype.type(1 << (self.levels - 1 - level))
            for k in range(0, self.n, RUN_IDS):
                own, part = bit[k : k + RUN_IDS], out[k : k + RUN_IDS]
                at, off = np.flatnonzero(own), np.flatnonzero(~own)
                part[off] = ids[a : a + len(off)]
                part[at] = ids[b : b + len(at)] | one
                a, b = a + len(off), b + len(at)
            ids = out
        return ids


def _levels(counts: np.ndarray) -> tuple[int, int]:
    """(levels of the first matrix, levels of the second) that move the fewest bits, for counts in falling order.

    A first matrix of k levels has the 2**k - 1 most frequent ids and a code for all others, which the second tells apart.
    """
    size, total = len(counts), int(counts.sum())
    before = np.concatenate([[0], np.cumsum(counts)])
    full = max(size - 1, 0).bit_length()
    own = [(total * full, full, 0)]
    for k in range(1, full):
        second = (size - (1 << k)).bit_length()
        own.append((total * k + (total - int(before[(1 << k) - 1])) * (second + 1), k, second))
    return min(own)[1:]


def _looked_up(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], RUN_IDS at a time, as numpy widens all indices first."""
    out = np.empty(len(at), table.dtype)
    for k in range(0, len(at), RUN_IDS):
        table.take(at[k : k + RUN_IDS], out=out[k : k + RUN_IDS], mode="clip")
    return out


def pack_ranked(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The ranked file of one shard. ids: uint16 or uint32; lengths: ids of each document, doc_ids int64."""
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    for k in range(0, len(ids), RUN_IDS):
        own = np.bincount(ids[k : k + RUN_IDS])
        counts[: len(own)] += own
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    first, second = _levels(counts[order])
    wide = np.uint16 if first <= 16 else np.uint32
    direct = (1 << first) - 1 if second else len(order)
    code = np.full(len(counts), direct if second else 0, wide)
    code[order[:direct]] = np.arange(direct)
    codes, rest = _looked_up(code, ids), ids[:0]
    if direct < len(order):
        code = np.zeros(len(counts), np.uint32)
        code[order[direct:]] = np.arange(len(order) - direct)
        rest = _looked_up(code, ids[np.flatnonzero(codes == direct)])
    alphabet = zstandard.ZstdCompressor(level=1).compress(order.tobytes())
    one, two = pack(codes, doc_ids, lengths, first), pack(rest, np.zeros(0), np.zeros(0), second)
    return b"".join([_RANKED.pack(RANKED, first, second, len(order), len(alphabet), len(one)), alphabet, one, two])


class RankedFile:
    """One ranked shard, read from its bytes."""

    def __init__(self, data: bytes):
        magic, first, second, size, own, one = _RANKED.unpack_from(data)
        if magic != RANKED:
            raise ValueError("not a ranked wavelet file")
        at = _RANKED.size
        self.alphabet = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + own]) if size else b"", "<u4")
        self.first, self.second = WaveletFile(data[at + own : at + own + one]), WaveletFile(data[at + own + one :])
        #: Ids with a code of their own; that number is the code of all others.
        self.direct = (1 << first) - 1 if second else size
        self.n, self.n_docs, self.doc_ids, self.lengths = self.first.n, self.first.n_docs, self.first.doc_ids, self.first.lengths

    def access(self, i: int) -> int:
        code = self.first.access(i)
        return int(self.alphabet[code if code < self.direct else code + self.second.access(self.first.count(code, 0, i))])

    def _code(self, token: int) -> int | None:
        at = np.flatnonzero(self.alphabet == token)
        return int(at[0]) if len(at) else None

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        code, hi = self._code(token), self.n if hi is None else hi
        if code is None:
            return 0
        if code < self.direct:
            return self.first.count(code, lo, hi)
        return self.second.count(code - self.direct, self.first.count(self.direct, 0, lo), self.first.count(self.direct, 0, hi))

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence, from 0."""
        code = self._code(token)
        if code is None:
            raise IndexError(j)
        if code < self.direct:
            return self.first.select(code, j)
        return self.first.select(self.direct, self.second.select(code - self.direct, j))

    def decode(self) -> np.ndarray:
        """All ids in order."""
        codes = self.first.decode()
        wide = self.alphabet.astype(np.uint16 if not len(self.alphabet) or self.alphabet.max() < 1 << 16 else np.uint32)
        ids = _looked_up(wide, codes)
        if self.second.n:
            ids[np.flatnonzero(codes == self.direct)] = _looked_up(wide[self.direct :], self.second.decode())
        return ids


def shard(data: bytes) -> RankedFile | WaveletFile:
    """The reader of a shard's bytes, whichever kind of file it is."""
    return (RankedFile if data[:4] == RANKED else WaveletFile)(data)
