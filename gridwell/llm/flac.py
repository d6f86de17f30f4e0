"""FLAC streams in numpy: many frames are coded side by side, one lane a frame.

The encoder writes mono 8-bit frames of one size with constant, verbatim, fixed and order-2 linear subframes; the
decoder reads any mono stream of up to 16 bits, with or without seek points, with fixed and linear predictors, partitioned Rice residuals of both kinds, escapes and wasted bits, and checks both frame checksums.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
#: Frames, and samples of frames, that are coded side by side: what bounds the memory of a long stream.
SLICE_FRAMES, SLICE_SAMPLES = 2048, 2048 * 576
_BPS = 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


class BadFrame(ValueError):
    """A frame that fails a checksum or breaks the format."""


def _right_aligned(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of bytes, padded with zeros on the left: zeros there leave a checksum that starts from zero."""
    width = int(sizes.max())
    at = starts[:, None] + sizes[:, None] - width + np.arange(width)[None]
    return np.where(at >= starts[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint8)


def crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    rows, c = np.ascontiguousarray(_right_aligned(buf, starts, sizes).T), np.zeros(len(starts), np.uint16)
    for col in rows:
        c = (c << 8) ^ _CRC16[(c >> 8) ^ col]
    return c


def crc8(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    rows, c = np.ascontiguousarray(_right_aligned(buf, starts, sizes).T), np.zeros(len(starts), np.uint16)
    for col in rows:
        c = _CRC8[c ^ col]
    return c.astype(np.uint8)


def _number(n: int) -> bytes:
    """A frame number, coded like an extended UTF-8 character."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([~(lead * 2 + 1) & 0xFF | n, *reversed(tail)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 15)


def _lpc2(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order-2 coefficients of each row in 8 signed bits with a shift of 6, and the residuals."""
    f = s.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1) + 1e-3, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    den = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    a1, a2 = r1 * (r0 - r2) / den, (r0 * r2 - r1 * r1) / den
    shift = 6
    c = np.clip(np.rint(np.stack([a1, a2], 1) * (1 << shift)), -128, 127).astype(np.int16)
    pred = (c[:, :1].astype(np.int32) * s[:, 1:-1] + c[:, 1:].astype(np.int32) * s[:, :-2]) >> shift
    return c, (s[:, 2:] - pred).astype(np.int16), shift


def _encode_frames(samples: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the frames and the size of each. samples: int16 rows of one block."""
    n, block = samples.shape
    plans = []
    for order, res in ((0, samples), (1, np.diff(samples, axis=1))):
        plans.append((order, None, res.astype(np.int16)))
    coef, res, shift = _lpc2(samples)
    plans.append((2, coef, res))
    cost, params = np.empty((3, n), np.int64), np.empty((3, n), np.int64)
    zz = []
    for p, (order, c, r) in enumerate(plans):
        z = _zigzag(r).astype(np.uint16)
        mean = z.mean(1, dtype=np.float32)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1.0))), 0, 13).astype(np.int64)
        cost[p] = (z >> k[:, None].astype(np.uint16)).sum(1, dtype=np.int64) + r.shape[1] * (k + 1) + 8 * order + (25 if c is not None else 0) + 10
        params[p] = k
        zz.append(z)
    pick = cost.argmin(0)
    bits = cost[pick, np.arange(n)]
    flat = (samples == samples[:, :1]).all(1)
    verbatim = ~flat & (bits >= block * _BPS)
    pick[flat], pick[verbatim] = 3, 4
    bits = np.where(flat, _BPS, np.where(verbatim, block * _BPS, bits))
    heads = []
    for number in numbers:
        head = b"\xff\xf8" + bytes([0x24, 0x02]) + _number(number)
        heads.append(head)
    head_size = np.array([len(h) + 1 for h in heads])
    size = head_size + (8 + bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    plane = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(at: np.ndarray, value, width: int) -> None:
        for j in range(width):
            plane[at + j] = (np.asarray(value) >> (width - 1 - j)) & 1

    begin = (start + head_size) * 8  # the subframe's first bit
    codes = np.array([0b00001000, 0b00001001, 0b00100001, 0, 1]) << 1
    put(begin, codes[pick], 8)
    for p, (order, c, r) in enumerate(plans):
        own = np.flatnonzero(pick == p)
        if not len(own):
            continue
        at = begin[own] + 8
        for j in range(order):
            put(at, samples[own, j].astype(np.int64) & 0xFF, 8)
            at = at + 8
        if c is not None:
            put(at, 7, 4)
            put(at + 4, shift, 5)
            put(at + 9, c[own, 0].astype(np.int64) & 0xFF, 8)
            put(at + 17, c[own, 1].astype(np.int64) & 0xFF, 8)
            at = at + 25
        k = params[p][own]
        put(at, 0, 6)
        put(at + 6, k, 4)
        at = at + 10
        z = zz[p][own].astype(np.int64)
        q = z >> k[:, None]
        length = q + 1 + k[:, None]
        stop = at[:, None] + np.cumsum(length, 1) - k[:, None] - 1
        plane[stop] = 1
        for width in np.unique(k):
            rows = k == width
            zs, ss = z[rows], stop[rows]
            for j in range(int(width)):
                plane[ss + 1 + j] = (zs >> (int(width) - 1 - j)) & 1
    if len(own := np.flatnonzero(pick == 3)):
        put(begin[own] + 8, samples[own, 0].astype(np.int64) & 0xFF, 8)
    if len(own := np.flatnonzero(pick == 4)):
        put((begin[own] + 8)[:, None] + 8 * np.arange(block), samples[own].astype(np.int64) & 0xFF, 8)
    out = np.packbits(plane)
    for h, a in zip(heads, start.tolist()):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    out[start + head_size - 1] = crc8(out, start, head_size - 1)
    crc = crc16(out, start, size - 2)
    out[start + size - 2], out[start + size - 1] = crc >> 8, crc & 0xFF
    return out, size


def encode_many(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A mono 8-bit stream of each payload, byte b as sample b - 128. Lengths are positive multiples of the block."""
    if any(len(p) == 0 or len(p) % block for p in payloads):
        raise ValueError(f"payloads are positive multiples of {block} bytes")
    if block != 576:
        raise ValueError("frames have 576 samples")
    counts = [len(p) // block for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, block)
    numbers = [k for c in counts for k in range(c)]
    parts = [_encode_frames(samples[k : k + SLICE_FRAMES], numbers[k : k + SLICE_FRAMES]) for k in range(0, len(samples), SLICE_FRAMES)]
    raw, size = b"".join(p.tobytes() for p, _ in parts), np.concatenate([z for _, z in parts])
    done, streams, at = 0, [], 0
    for p, c in zip(payloads, counts):
        own = size[done : done + c]
        offs = np.concatenate([[0], np.cumsum(own)])
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", block, block) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | (_BPS - 1) << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(c, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["offset"], points["count"] = np.arange(c) * block, offs[:-1], block
        seek = points.tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[at : at + int(offs[-1])])
        at += int(offs[-1])
        done += c
    return streams


def stream_info(data: bytes) -> dict:
    """STREAMINFO fields, seek points (sample, byte offset, samples) and where the frames start."""
    if data[:4] != b"fLaC":
        raise BadFrame("not a FLAC stream")
    at, last, info, seek = 4, False, None, np.zeros((0, 3), np.int64)
    while not last:
        if at + 4 > len(data):
            raise BadFrame("metadata end early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"min_block": int.from_bytes(body[0:2], "big"), "max_block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            points = points[points["sample"] != np.uint64(0xFFFFFFFFFFFFFFFF)]
            seek = np.stack([points["sample"].astype(np.int64), points["offset"].astype(np.int64), points["count"].astype(np.int64)], 1)
        at += 4 + size
    if info is None:
        raise BadFrame("no STREAMINFO")
    return info | {"seek": seek, "frames": at}


class _Lanes:
    """Bit cursors over one buffer."""

    def __init__(self, raw: bytes):
        self.buf = raw + bytes(16)
        self.words = np.ndarray((len(self.buf) - 7,), ">u8", self.buf, 0, (1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each cursor on, at the top of a word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        if width == 0:
            return np.zeros(len(at), np.int64)
        return (self.peek(at) >> np.uint64(64 - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.read(at, width)
        return v - ((v >> (width - 1)) << width) if width else v


_LZ16 = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def _residuals(lanes: _Lanes, at: np.ndarray, order: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames with one predictor order (samples in rows of time), and the cursors after them."""
    method, parts = lanes.read(at, 2), lanes.read(at + 2, 4)
    at, out = at + 6, np.zeros((block, len(at)), np.int64)
    if (method > 1).any():
        raise BadFrame("reserved residual coding")
    for m in (0, 1):
        for po in np.unique(parts[method == m]):
            own = np.flatnonzero((method == m) & (parts == po))
            cur, width, size = at[own], 5 if m else 4, block >> int(po)
            if size << int(po) != block or size < order:
                raise BadFrame("partitions do not fit the block")
            res = np.zeros((block, len(own)), np.int64)
            for part in range(1 << int(po)):
                lo, hi = (order if part == 0 else part * size), (part + 1) * size
                k = lanes.read(cur, width)
                cur = cur + width
                raw = k == (1 << width) - 1
                if raw.any():
                    e = np.flatnonzero(raw)
                    bits = lanes.read(cur[e], 5)
                    c = cur[e] + 5
                    for t in range(lo, hi):
                        for b in np.unique(bits):
                            s = bits == b
                            res[t, e[s]] = lanes.signed(c[s], int(b))
                        c = c + bits
                    cur[e] = c
                live = np.flatnonzero(~raw) if raw.any() else slice(None)
                c, kk = cur[live], k[live]
                down = (np.uint64(63) - kk.astype(np.uint64))
                for t in range(lo, hi):
                    x = lanes.peek(c)
                    q = _LZ16[(x >> np.uint64(48)).astype(np.int64)]
                    if (q == 16).any():  # a long run of zeros: step over it until each lane sees its one
                        far = np.flatnonzero(q == 16)
                        run, go = q.copy(), far
                        while len(go):
                            y = lanes.read(c[go] + run[go], 16)
                            more = _LZ16[y]
                            run[go] += more
                            go = go[more == 16]
                            if len(go) and (run[go] > 1 << 20).any():
                                raise BadFrame("endless run")
                        q = run
                        x = lanes.peek(c + q) << np.uint64(1)
                    else:
                        x = x << (q.astype(np.uint64) + np.uint64(1))
                    v = (q << kk) | ((x >> np.uint64(1)) >> down).astype(np.int64)
                    res[t, live] = (v >> 1) ^ -(v & 1)
                    c = c + (q + 1 + kk)
                cur[live] = c
            out[:, own], at[own] = res, cur
    return out, at


def _subframes(lanes: _Lanes, at: np.ndarray, bps: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row each frame) and cursors after the subframes, for frames of one block size."""
    head = lanes.read(at, 8)
    kind, wasted, at = head >> 1 & 63, np.zeros(len(at), np.int64), at + 8
    for f in np.flatnonzero(head & 1):
        while not lanes.read(at[[f]] + wasted[f], 1)[0]:
            wasted[f] += 1
        wasted[f] += 1
        at[f] += wasted[f]
    out = np.zeros((len(at), block), np.int64)
    for code in np.unique(kind):
        for w in np.unique(wasted[kind == code]):
            own, width = np.flatnonzero((kind == code) & (wasted == w)), bps - int(w)
            cur = at[own]
            if code == 0:
                s, cur = np.repeat(lanes.signed(cur, width)[:, None], block, 1), cur + width
            elif code == 1:
                s = np.stack([lanes.signed(cur + width * t, width) for t in range(block)], 1)
                cur = cur + width * block
            elif 8 <= code <= 12 or code >= 32:
                order = int(code) - 8 if code < 32 else int(code) - 31
                warm = [lanes.signed(cur + width * t, width) for t in range(order)]
                cur = cur + width * order
                if code >= 32:
                    precision, shift = lanes.read(cur, 4) + 1, lanes.signed(cur + 4, 5)
                    cur, coef = cur + 9, np.zeros((order, len(own)), np.int64)
                    for b in np.unique(precision):
                        p = precision == b
                        for j in range(order):
                            coef[j, p] = lanes.signed(cur[p] + int(b) * j, int(b))
                    cur = cur + precision * order
                res, cur = _residuals(lanes, cur, order, block)
                for t, x in enumerate(warm):
                    res[t] = x
                if code >= 32:
                    for t in range(order, block):
                        acc = coef[0] * res[t - 1]
                        for j in range(1, order):
                            acc += coef[j] * res[t - 1 - j]
                        res[t] += acc >> shift
                elif order:
                    fixed = {1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}[order]
                    if order == 1:
                        res = np.cumsum(res, axis=0)
                    else:
                        for t in range(order, block):
                            res[t] += sum(c * res[t - 1 - j] for j, c in enumerate(fixed))
                s = res.T
            else:
                raise BadFrame("reserved subframe")
            out[own], at[own] = s << int(w), cur
    return out, at


def _header(raw: bytes, a: int) -> tuple[int, int, int, int]:
    """(block size, bits a sample, frame or sample number, header bytes without its checksum)."""
    if raw[a] != 0xFF or raw[a + 1] & 0xFE != 0xF8:
        raise BadFrame("no frame here")
    size_code, rate_code, channels, bps_code = raw[a + 2] >> 4, raw[a + 2] & 15, raw[a + 3] >> 4, raw[a + 3] >> 1 & 7
    at, first = a + 4, raw[a + 4]
    extra = 0 if first < 0x80 else next(k for k in range(1, 8) if not first & (0x40 >> k)) if first & 0x40 else 1
    number = first if first < 0x80 else first & (0x3F >> extra)
    for k in range(extra):
        number = number << 6 | raw[at + 1 + k] & 0x3F
    at += 1 + extra
    if size_code == 6:
        block, at = raw[at] + 1, at + 1
    elif size_code == 7:
        block, at = int.from_bytes(raw[at : at + 2], "big") + 1, at + 2
    else:
        block = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if channels:
        raise BadFrame("one channel only")
    return block, {1: 8, 2: 12, 4: 16}.get(bps_code, 0), number, at - a


def _offsets(data: bytes, info: dict) -> np.ndarray:
    """Where the frames of a stream start: its seek points if there is one for each frame, or else sync codes.

    A sync code starts a frame if its header's checksum and number fit and the checksum of the frame before ends there.
    """
    seek, size, first = info["seek"], len(data), info["frames"]
    if len(seek) and info["samples"] == seek[:, 2].sum() and (seek[:, 0] == np.cumsum(seek[:, 2]) - seek[:, 2]).all() and seek[0, 1] == 0 and (np.diff(seek[:, 1]) > 0).all() and first + seek[-1, 1] < size:
        return seek[:, 1] + first
    if first >= size:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    at, heads = [], []
    for a in (np.flatnonzero((buf[first:-1] == 0xFF) & (buf[first + 1 :] & 0xFE == 0xF8)) + first).tolist():
        try:
            head = _header(data, a)
            if crc8(buf, np.array([a]), np.array([head[3]]))[0] == buf[a + head[3]]:
                at.append(a)
                heads.append(head)
        except (ValueError, IndexError, StopIteration):
            if a == first:
                raise
    if not at or at[0] != first:
        raise BadFrame("no frame here")
    ends = np.array([*at[1:], size])

    def fits(k: np.ndarray, end: np.ndarray) -> np.ndarray:
        begin = np.array(at)[k]
        crc = crc16(buf, begin, np.maximum(end - begin - 2, 0))
        return (crc >> 8 == buf[end - 2]) & (crc & 0xFF == buf[end - 1])

    whole = np.concatenate([fits(np.arange(k, min(k + 256, len(at))), ends[k : k + 256]) for k in range(0, len(at), 256)])
    out, k, samples = [], 0, 0
    while k < len(at):
        out.append(at[k])
        samples += heads[k][0]
        number = samples if data[at[k] + 1] & 1 else len(out)
        follow = next((j for j in range(k + 1, len(at)) if heads[j][2] == number and (whole[k] if j == k + 1 else fits(np.array([k]), np.array([at[j]]))[0])), len(at))
        k = follow
    return np.array(out, np.int64)


def decode_many(streams: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(stream_info, samples) of each stream; all frames of all streams are decoded side by side.

    Raises BadFrame where a checksum, a sample count or the stream's MD5 is wrong.
    """
    infos, starts, sizes, at = [stream_info(s) for s in streams], [], [], 0
    for s, info in zip(streams, infos):
        if info["bps"] > 16 or info["channels"] > 1:
            raise BadFrame("one channel of 16 bits at most")
        offs = _offsets(s, info)
        starts.append(offs + at)
        sizes.append(np.diff(np.append(offs, len(s))))
        at += len(s)
    start, size = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*sizes, np.zeros(0, np.int64)])
    raw, bps = b"".join(streams), np.repeat([i["bps"] for i in infos], [len(s) for s in starts])
    most = max([i["max_block"] for i in infos if i["max_block"]], default=1 << 16)
    step, frames = max(1, min(SLICE_FRAMES, SLICE_SAMPLES // most)), []
    for k in range(0, len(start), step):
        own, until = start[k : k + step], start[k : k + step] + size[k : k + step]
        low, high = int(own.min()), int(until.max())
        frames += _frames(raw[low:high], own - low, size[k : k + step], bps[k : k + step])
    out, done = [], 0
    for info, s in zip(infos, starts):
        samples = np.concatenate([*frames[done : done + len(s)], np.zeros(0, np.int16)])
        done += len(s)
        if info["samples"] and len(samples) != info["samples"]:
            raise BadFrame("sample count")
        wide = samples.astype("<i1" if info["bps"] <= 8 else "<i2")
        if any(info["md5"]) and hashlib.md5(wide.tobytes()).digest() != info["md5"]:
            raise BadFrame("MD5")
        out.append((info, samples))
    return out


def _frames(raw: bytes, start: np.ndarray, size: np.ndarray, bps_of: np.ndarray) -> list[np.ndarray]:
    """The samples of each frame, after both of its checksums."""
    buf = np.frombuffer(raw, np.uint8)
    crc = crc16(buf, start, size - 2)
    if ((crc >> 8 != buf[start + size - 2]) | (crc & 0xFF != buf[start + size - 1])).any():
        raise BadFrame("frame checksum")
    heads = [_header(raw, a) for a in start.tolist()]
    hsize = np.array([h[3] for h in heads])
    if (crc8(buf, start, hsize) != buf[start + hsize]).any():
        raise BadFrame("header checksum")
    lanes, frames = _Lanes(raw), [None] * len(start)
    shapes = {}
    for f, h in enumerate(heads):
        shapes.setdefault((h[0], h[1] or int(bps_of[f])), []).append(f)
    for (block, bps), own in shapes.items():
        own = np.array(own)
        got, end = _subframes(lanes, (start[own] + hsize[own] + 1) * 8, bps, block)
        if ((end + 7) // 8 + 2 != start[own] + size[own]).any():
            raise BadFrame("frame length")
        for f, row in zip(own.tolist(), got):
            frames[f] = row.astype(np.int16 if bps <= 16 else np.int64)
    return frames
