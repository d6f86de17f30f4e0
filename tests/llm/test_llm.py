"""Brute-force versions, round trips and edge rows of the corpus operators."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from gridwell.llm import contain, deobfuscate, flac, ftrl, line_chunks, media, queries, simhash, template, token_shards, url_tree, word_bpe
from gridwell.llm.chunked_bpe import SpacePieces, tokenizer
from gridwell.llm.wavelet import WaveletFile, pack

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))


def texts(n=120, seed=1):
    r = random.Random(seed)
    base = [" ".join(word(r) for _ in range(r.randint(0, 60))) for _ in range(n // 2)]
    near = [t + " " + word(r) for t in r.choices(base, k=n // 4)]
    return base + near + r.choices(base, k=n - len(base) - len(near))


ODD = [(None, "lonely words here", 1), (7, None, 2), (8, "", 3), (9, "", None), (10, "é́ Σ\u00a0x \x1c <|endoftext|> y\n\n z  q", 5), (10, "other text, same id", 6), (11, "same row", 7), (11, "same row", 7), (12, "word " * 30_000, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 + k, t, k) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + ODD, DOC).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_wavelet_round_trip_and_lookup():
    r = np.random.default_rng(3)
    ids = r.integers(0, 300, 150_000).astype(np.uint16)
    ids[:5] = 65535
    f = WaveletFile(pack(ids, np.array([4, 9]), np.array([70_000, 80_000])))
    assert (f.decode() == ids).all() and list(f.doc_ids) == [4, 9] and list(f.lengths) == [70_000, 80_000]
    for t in (0, 17, 299, 65535, 400):
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at)
        assert f.count(t, 1000, 77_777) == np.count_nonzero(ids[1000:77_777] == t)
        for j in (0, len(at) // 2, len(at) - 1):
            if len(at):
                assert f.select(t, j) == at[j] and f.access(int(at[j])) == t
    assert WaveletFile(pack(np.zeros(0, np.uint16), np.zeros(0), np.zeros(0))).decode().size == 0


def test_space_pieces_equal_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = SpacePieces(path)
    r = random.Random(5)
    some = ["".join(r.choice(["a", "B", " ", " ", "\n", "\na", "b\n", "x.", "é,", "1", "'s", ".", "é", "\u00a0", "\t", "<|endoftext|>"]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for end in (None, 7):
        ids, sizes = coder.encode(pa.array(some), end)
        for t, got in zip(some, np.split(ids, np.cumsum(sizes)[:-1])):
            assert coder.tok.encode(t, add_special_tokens=False).ids + [7] * (end == 7) == got.tolist(), repr(t)


def test_op3_shards(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_shards.read_shards(token_shards.write_shards(docs, path, shard_ids=500)).collect()
    tok = SpacePieces(path).tok
    rows = sorted(((d, t) for d, t, _ in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start, want = 0, []
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda x: (x[1],)
    assert sorted(map(tuple, got), key=key) == want
    assert token_shards.read_shards(token_shards.write_shards(empty(spark), path)).count() == 0


def test_op6_words(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizer(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in docs.collect():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    key = lambda x: tuple(map(str, x))
    clash = docs.withColumnRenamed("n", "block").withColumn("ids", F.lit(1))
    assert sorted(map(tuple, word_bpe.digests(clash, path).collect()), key=key) == sorted(want, key=key)
    one = word_bpe.encode_decode(docs.filter("doc_id = 11"), path).collect()
    assert len(one) == 2 and one[0].ids == tok.encode("same row", add_special_tokens=False).ids
    assert word_bpe.digests(empty(spark), path).count() == 0


@pytest.mark.parametrize("limit", [60, 5000, 1 << 25])
def test_distinct_words_equal_whole_texts(monkeypatch, limit):
    """White space of all kinds, letters that change size when lowered, signs, special tokens, blocks of any size."""
    for name in ("BLOCK_BYTES", "SLICE_WORDS", "ENCODE_WORDS"):
        monkeypatch.setattr(word_bpe, name, limit)
    monkeypatch.setattr(word_bpe, "SPLIT_BYTES", min(limit, 1000) // 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizer(path)
    texts = ["it's, IT'S. <|endoftext|>, <|ENDOFTEXT|> a\tb\r\nc\x1ce\x85f\xa0g\u3000h", None, "", "  \n\n", "\u0130\u0130. \u03a3\u0391\u03a3, e\u0301! \ufb01; a\u180eb", " \u0308x, \u4e2d\u6587.", "A.. b*** C's d' e.<|endoftext|>. x=\u2260 \u0130! \u01c4a. \u00c9t\u00e9*** <|endoftext|>.", "\x00\x01 a"]
    pick = random.Random(1)
    texts += ["".join(pick.choice("aB,. \n\t'sS!\u0301\u03a3\u03c3\u01301_\x1c<|>\u00aa\u4e2d") for _ in range(pick.randint(0, 40))) for _ in range(1500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 100, len(texts))), pa.int64()), pa.array(texts[k : k + 100], pa.string())], names=["doc_id", "text"]) for k in range(0, len(texts), 100)]
    blocks = list(word_bpe._block_rows(iter(batches), 3))
    rows = sorted((w, b.column(0)[0].as_py(), k) for b in blocks for k, w in enumerate(b.column(4)[0].as_py()))
    held = [pa.RecordBatch.from_arrays([pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int32()), pa.array([x[0] for x in part])], names=["block", "k", "word"]) for part in (rows[i : i + 97] for i in range(0, len(rows), 97))]
    found = pa.Table.from_batches(list(word_bpe._encoded(iter(held), path)))
    seen = 0
    for b in blocks:
        own = found.filter(pa.compute.equal(found["of"], b.column(0)[0]))
        for ids_of, count, ids, decoded in word_bpe._assembled(pa.Table.from_batches([b]), own, path):
            for d, n, i, x in zip(ids_of.to_pylist(), count.tolist(), ids.to_pylist(), decoded.to_pylist()):
                want = tok.encode(texts[d] or "", add_special_tokens=False).ids
                assert (n, i, x) == (len(want), " ".join(map(str, want)), tok.decode(want, skip_special_tokens=False)), texts[d]
                seen += 1
    assert seen == len(texts)


def brute_groups(rows):
    fps = [simhash.fingerprint(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted([(str(d), fps[k], low.get(find(k))) for k, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("parts,block", [(None, 4096), (4, 3), (3, 4096), (2, 5), (1, 4096)])
def test_op5_groups(spark, docs, parts, block):
    rows = [(d, t) for d, t, _ in docs.filter("n < 40 or n is null or doc_id > 180").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if parts == 1:
        df, rows = df.limit(0), []
    got = simhash.groups(df, parts=None if parts == 1 else parts, block_rows=block).collect()
    assert sorted([(str(d), f & (1 << 64) - 1, c) for d, f, c in got], key=str) == brute_groups(rows)


def test_op5_dense_ball(spark):
    r = random.Random(9)
    fps = {0}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        fps.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    far = {r.getrandbits(64) for _ in range(300)}
    every = sorted(fps | far)
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    from gridwell.operators.components import connected_components

    got = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block_rows=20)).collect()
    comp = {}
    for n, c in got:
        comp.setdefault(c, set()).add(n & (1 << 64) - 1)
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    want = {}
    for x in every:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, comp.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_radii_sum_and_least_cost():
    r = np.random.default_rng(2)
    for m, total in ((4, 0), (3, 1), (2, 2)):
        costs = [np.cumsum(np.concatenate([np.zeros((40, 1)), r.random((40, 4))], 1), 1) for _ in range(m)]
        got = simhash.radii(costs, total)
        assert (got.sum(1) == total).all()
        for q in range(40):
            import itertools

            best = min(sum(costs[i][q, e[i] + 1] for i in range(m)) for e in itertools.product(range(-1, 4), repeat=m) if sum(e) == total)
            assert abs(sum(costs[i][q, got[q, i] + 1] for i in range(m)) - best) < 1e-9


def test_flac_round_trip_and_checksums():
    r = np.random.default_rng(4)
    loads = [b"\xff" * 576, bytes(r.integers(0, 256, 576 * 3, dtype=np.uint8)), (b"the quick brown fox " * 60)[:1152], bytes([0, 255] * 288), bytes(575) + b"\xff", bytes((np.sin(np.arange(576 * 200) / 9) * 90 + 128).astype(np.uint8))]
    streams = flac.encode_many(loads)
    for load, (info, s) in zip(loads, flac.decode_many(streams)):
        assert (s + 128).astype(np.uint8).tobytes() == load and info["samples"] == len(load)
        assert (info["seek"][:, 0] == np.arange(len(load) // 576) * 576).all()
    bad = bytearray(streams[2])
    bad[-20] ^= 4
    with pytest.raises(flac.BadFrame):
        flac.decode_many([bytes(bad)])


def without_seek(stream, keep=0, edit=lambda info: info):
    """The stream with every `keep`-th seek point, or without a table."""
    size = int.from_bytes(stream[43:46], "big")
    points = [stream[46 + k : 64 + k] for k in range(0, size, 18)][:: keep or size]
    table = b"\x83" + (18 * len(points)).to_bytes(3, "big") + b"".join(points) if keep else b""
    return b"fLaC" + (b"\x00" if keep else b"\x80") + stream[5:8] + edit(stream[8:42]) + table + stream[46 + size :]


def test_flac_without_seek_points(spark):
    r = np.random.default_rng(6)
    noise = bytearray(r.integers(0, 256, 576 * 5, dtype=np.uint8))
    fake = b"\xff\xf8\x24\x02\x01"
    fake += bytes(flac.crc8(np.frombuffer(fake, np.uint8), np.array([0]), np.array([5])))
    noise[100:106] = bytes(b ^ 0x80 for b in fake)  # a header inside of frame 0 that says it is frame 1
    loads = [bytes(noise), bytes(r.integers(0, 256, 576 * 300, dtype=np.uint8)), (b"the quick brown fox " * 200)[: 576 * 4], b"\xff" * 576]
    whole = flac.encode_many(loads)
    bare, sparse = [without_seek(s) for s in whole], [without_seek(s, 2) for s in whole]
    assert fake in bare[0]
    for streams in (bare, sparse, [whole[0], bare[1], sparse[2], bare[3]]):
        assert [(s + 128).astype(np.uint8).tobytes() for _, s in flac.decode_many(streams)] == loads
    empty = bare[2][:42]
    unknown = without_seek(whole[2], edit=lambda i: i[:13] + bytes([i[13] & 0xF0]) + bytes(4) + i[18:])
    assert (flac.decode_many([unknown])[0][1] + 128).astype(np.uint8).tobytes() == loads[2]
    torn = bytearray(bare[1])
    torn[5000] ^= 1
    for bad in (empty, bare[2][:-100], bytes(torn), bare[2][:20], whole[2][:-100]):
        for batch in ([bad], [bad, whole[3]], [bare[0], bad]):
            with pytest.raises(flac.BadFrame):
                flac.decode_many(batch)
    rows = spark.createDataFrame(list(enumerate(map(bytearray, bare))), "k long, media binary")
    got = media.pcm_blocks(rows, "k").collect()
    for k, load in enumerate(loads):
        assert bytes(b ^ 0x80 for x in sorted(got, key=lambda g: g.block) if x.k == k for b in x.pcm) == load


def test_op9_media(spark, docs):
    want = []
    for d, t, _ in docs.collect():
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((str(d), len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])))
    got = media.media_digest(docs.withColumnRenamed('n', 'media')).collect()
    assert sorted((str(g[0]), *g[1:5]) for g in got) == sorted(want)
    blocks = media.pcm_blocks(media.text_media(docs.filter("doc_id = 12")), "doc_id", block=1000).collect()
    pcm = b"".join(b.pcm for b in sorted(blocks, key=lambda b: b.first_sample))
    assert bytes(x ^ 0x80 for x in pcm).rstrip(b"\xff") == b"word " * 30_000
    assert media.pcm_blocks(spark.createDataFrame([(1, None)], "k long, media binary"), "k").count() == 0
    assert media.media_digest(empty(spark)).count() == 0


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - k) & 1 for k in range(width)]

    def rice(self, value, k):
        z = value * 2 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (z >> k) + [1]
        self.put(z & (1 << k) - 1, k)

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << 7 - k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def crc(data, poly, width):
    c = 0
    for byte in data:
        c ^= byte << width - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> width - 1 else c << 1) & (1 << width) - 1
    return c


def hand_made(frames, bps, edit=bytes):
    """A stream of frames (samples, kind, options) written bit by bit after the format's description."""
    out, total = b"", b""
    for number, (x, kind, o) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x60, {8: 1, 12: 2, 16: 4}[bps] << 1, number, len(x) - 1])
        f, w = Bits(), o.get("wasted", 0)
        s, width = [v >> w for v in x], bps - w
        code = {"constant": 0, "verbatim": 1, "fixed": 8 + o.get("order", 0), "lpc": 31 + o.get("order", 0)}[kind]
        f.put(code << 1 | (w > 0), 8)
        if w:
            f.put(1, w)
        if kind == "constant":
            f.put(s[0], width)
        elif kind == "verbatim":
            for v in s:
                f.put(v, width)
        else:
            order = o["order"]
            for v in s[:order]:
                f.put(v, width)
            if kind == "lpc":
                f.put(o["precision"] - 1, 4)
                f.put(o["shift"], 5)
                for c in o["coefficients"]:
                    f.put(c, o["precision"])
                guess = lambda t: sum(c * s[t - 1 - j] for j, c in enumerate(o["coefficients"])) >> o["shift"]
            else:
                guess = lambda t: {0: lambda: 0, 1: lambda: s[t - 1], 2: lambda: 2 * s[t - 1] - s[t - 2], 3: lambda: 3 * s[t - 1] - 3 * s[t - 2] + s[t - 3], 4: lambda: 4 * s[t - 1] - 6 * s[t - 2] + 4 * s[t - 3] - s[t - 4]}[order]()
            res, parts, method = [s[t] - guess(t) for t in range(order, len(s))], o["parameters"], o.get("method", 0)
            f.put(method, 2)
            f.put(len(parts).bit_length() - 1, 4)
            size, at = len(s) // len(parts), 0
            for p, k in enumerate(parts):
                own = res[at : at + size - (order if p == 0 else 0)]
                at += len(own)
                if k is None:  # escape: plain bits
                    f.put(31 if method else 15, 5 if method else 4)
                    need = max(1 + max(abs(v) for v in own).bit_length(), 1) if any(own) else 0
                    f.put(need, 5)
                    for v in own:
                        f.put(v, need)
                else:
                    f.put(k, 5 if method else 4)
                    for v in own:
                        f.rice(v, k)
        frame = head + bytes([crc(head, 0x07, 8)]) + f.bytes()
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
        total += b"".join(v.to_bytes(1 if bps <= 8 else 2, "little", signed=True) for v in x)
    n = sum(len(x) for x, _, _ in frames)
    info = (16).to_bytes(2, "big") + (256).to_bytes(2, "big") + bytes(6) + (44100 << 44 | (bps - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(total).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + edit(out)


def test_flac_hand_made_streams():
    """Predictors of high order, partitions, escapes, wide Rice codes, wasted bits, long runs of zeros, samples of 8, 12 and 16 bits."""
    r = random.Random(41)
    walk = [0]
    for _ in range(255):
        walk.append(max(-2000, min(2000, walk[-1] + r.randint(-90, 90))))
    low = [v // 20 for v in walk]
    for bps, x in ((16, walk), (12, [v // 2 for v in walk]), (8, low)):
        jump = x[:100] + [x[100] + (400 if bps > 8 else 25)] + x[101:]
        frames = [
            (x, "lpc", {"order": 4, "precision": 10, "shift": 5, "coefficients": [40, -12, 5, -2], "method": 1, "parameters": [6, None]}),
            (x[:192], "lpc", {"order": 12, "precision": 7, "shift": 4, "coefficients": [9, 3, 2, 1, 1, 0, -1, 0, 1, -1, 0, 1], "parameters": [5, 4, None, 6]}),
            ([v // 4 * 4 for v in x], "fixed", {"order": 3, "wasted": 2, "parameters": [3, 4, 0, 5]}),
            (jump, "fixed", {"order": 4, "parameters": [2]}),
            (x, "fixed", {"order": 0, "parameters": [0] if bps == 8 else [1]}),
            (x[:64], "verbatim", {}),
            ([x[7]] * 100, "constant", {}),
            ([0] * 32, "fixed", {"order": 1, "parameters": [None, None]}),
            (x, "fixed", {"order": 2, "parameters": [4] * 16, "method": 1}),
        ]
        stream = hand_made(frames, bps)
        info, got = flac.decode_many([stream])[0]
        assert got.tolist() == [v for f, _, _ in frames for v in f] and info["bps"] == bps
        with pytest.raises(flac.BadFrame):
            flac.decode_many([hand_made(frames, bps, lambda b: b[:40] + bytes([b[40] ^ 1]) + b[41:])])


def test_flac_slices_of_long_streams(monkeypatch):
    monkeypatch.setattr(flac, "SLICE_FRAMES", 7)
    load = bytes(np.random.default_rng(5).integers(60, 130, 576 * 40, dtype=np.uint8))
    streams = flac.encode_many([load, load[: 576 * 3]])
    assert [(x + 128).astype(np.uint8).tobytes() for _, x in flac.decode_many(streams)] == [load, load[: 576 * 3]]
    monkeypatch.undo()
    assert flac.encode_many([load, load[: 576 * 3]]) == streams


def chunk_model(rows):
    """Lines removed of each (doc_id, text), worked out apart: boundaries by hashes over two lines, then every span's bytes."""
    import xxhash

    held = {}
    docs = {(d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42), t): None for d, t in rows if t}
    order = sorted(docs, key=lambda x: (x[0], x[1], x[2] - (1 << 64) if x[2] >> 63 else x[2]))
    for key in order:
        lines = key[3].encode().split(b"\n")
        h = [xxhash.xxh64_intdigest(x) for x in lines]
        edges = [i for i in range(len(lines)) if lines[i].strip() and not ((h[i] + (h[i - 1] * line_chunks._MUL if i else 0)) % (1 << 64)) >> 17 & 1]
        spans = {(a, b + 1) for a, b in zip(edges, edges[1:])}
        words = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(words[a:b]) >= 50 and (words[a] and sum(words[a : b - 1]) < 50 or words[b - 1] and sum(words[a + 1 : b]) < 50):
                    spans.add((a, b))
        for a, b in sorted(spans):
            held.setdefault(b"\n".join(lines[a:b]), []).append((key, a, b))
    gone = {}
    for places in held.values():
        first = min(places, key=lambda p: (order.index(p[0]), p[1]))
        for key, a, b in places:
            if (key, a) != first[:2]:
                gone.setdefault((key[1] if not key[0] else None, key[3]), set()).update(range(a, b))
    return gone


def test_op2_matches_chunk_model(spark):
    r = random.Random(11)
    line = lambda n: " ".join(word(r) + word(r) for _ in range(n))
    shared = [[line(r.randint(1, 20)) for _ in range(r.randint(2, 8))] for _ in range(6)] + [[line(60)], [line(14)] * 3, ["", line(30), "", line(25)]]
    rows = []
    for k in range(60):
        text = [line(r.randint(0, 14)) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            text += r.choice(shared) + [line(r.randint(0, 14)) for _ in range(r.randint(0, 3))]
        rows.append((k, "\n".join(text), k))
    rows += [(None, rows[5][1], 60), (2**63 - 1, rows[5][1], 61), *rows[8:11]]
    df = spark.createDataFrame(rows + ODD, DOC).withColumnRenamed("n", "spans").withColumn("row", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("k1", F.lit(2))
    want = chunk_model([(d, t) for d, t, _ in rows + ODD])
    got = line_chunks.dedup_lines(df)
    assert got.columns == [*df.columns, "lines_removed"]
    cut = {}
    for x in got.collect():
        t = next(t for d, t, n in rows + ODD if d == x.doc_id and n == x.spans)
        gone = want.get((x.doc_id, t), set())
        assert x.lines_removed == len(gone) and x.text == (None if t is None else "\n".join(y for i, y in enumerate(t.split("\n")) if i not in gone)), x
        cut[x.doc_id] = len(gone)
    assert got.count() == df.count() and sum(map(bool, cut.values())) > 30
    assert line_chunks.dedup_lines(empty(spark)).count() == 0


def test_op2_passages(spark):
    """Passages of 50 words go to their last line wherever they stand, and each first place stays, as do other lines."""
    r = random.Random(29)
    line = lambda n: " ".join(word(r) + word(r) for _ in range(n))
    shapes = [[6] * 9, [5] * 11, [7] * 8, [4, 47], [47, 4], [1] * 50, [3, 60, 2], [20, 0, 5, 0, 25], [14, 20, 9, 18], [60], [25, 25]]
    rows, want, k = [], {}, 0
    for shape in shapes:
        passage = [line(n) for n in shape]
        for place in range(8):
            before, after = [line(r.randint(1, 12)) for _ in range(r.randint(0, 3))], [line(r.randint(1, 12)) for _ in range(r.randint(0, 3))]
            rows.append((k, "\n".join(before + passage + after), k))
            want[k] = "\n".join(before + (passage if place == 0 else []) + after)
            k += 1
    again = line(5)
    rows += [(k, "\n".join([again] * 40), k), (k + 1, "a\tb " + "\t".join(word(r) for _ in range(60)), k), (k + 2, rows[0][1] + "\n" + "own words", k)]
    rows += [(k + 10 + j, "\n".join([line(9), line(3), line(11)]), k) for j in range(20)]  # clean ones
    want |= {d: t for d, t, _ in rows[-20:]}
    got = {x.doc_id: x.text for x in line_chunks.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[d] == t for d, t in want.items())
    assert got[k].startswith(again) and got[k + 1] == rows[len(shapes) * 8 + 1][1] and got[k + 2].endswith("own words")


def test_op2_windows_cover_every_passage():
    r = random.Random(31)
    for _ in range(300):
        lines = [b" ".join(b"w" for _ in range(r.choice([0, 1, 3, 7, 9, 20, 55]))) for _ in range(r.randint(1, 25))]
        spans = line_chunks.windows(lines)
        size = [len(x.split()) for x in lines]
        assert all(sum(size[a:b]) >= 50 for a, b in spans)
        for s in range(len(lines)):
            for t in range(s + 1, len(lines) + 1):
                if sum(size[s:t]) >= 50 and all(size[s:t]):
                    assert {k for a, b in spans if a >= s and b <= t for k in range(a, b)} == set(range(s, t))


def test_op2_shared_short_chunks(spark):
    """A repeated chunk goes however few words it has."""
    r = random.Random(33)
    line = lambda n: " ".join(word(r) + word(r) for _ in range(n))
    shared = [line(14) for _ in range(3)]
    got = line_chunks.dedup_lines(spark.createDataFrame([(k, "\n".join([*shared, line(9)]), k) for k in range(5)] + [(9, "\n".join(shared[:1]), 9)], DOC)).collect()
    edges = line_chunks.chunks([x.encode() for x in shared])
    for x in got:
        assert x.lines_removed == (0 if x.doc_id in (0, 9) else len({k for a, b in edges for k in range(a, b)}))


def test_op8_matches_brute_force(spark):
    r = random.Random(13)
    items = [(k, " ".join(word(r) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 20, 33, 64, 65, 120])] + [(50, None), (51, " "), (None, "some words of an item without id")]
    rows = []
    for k in range(150):
        w = [word(r) for _ in range(r.randint(0, 80))]
        own = (r.choice(items)[1] or "").split()
        for _ in range(r.randint(0, 3)):
            if own:
                own[r.randrange(len(own))] = word(r)
        at = r.randint(0, len(w))
        rows.append((k, " \n".join(w[:at] + own + w[at:]), k))
    df = spark.createDataFrame(rows + ODD, DOC)

    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    want = set()
    for d, t, _ in rows + ODD:
        for i, x in items:
            if grams(x) and len(grams(x) & grams(t)) >= 0.8 * len(grams(x)) - 1e-9:
                want.add((d, i, len(grams(x) & grams(t)), len(grams(x))))
    got = contain.contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and {tuple(g[:4]) for g in got} == want and len(got) == len(want)
    assert contain.contained(empty(spark), df.selectExpr("doc_id item_id", "text")).count() == 0


def test_op4_restores_and_learns(spark):
    r = random.Random(17)
    bad = ["nasty", "rotten", "wicked"]
    rows = [(k, " ".join([word(r) for _ in range(20)] + ([r.choice(bad)] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    trained = deobfuscate.train(df, df, F.lit(True))
    probes = spark.createDataFrame([(1, "so n4sty today"), (2, "so r.o.t.t.e.n today"), (3, "w1ck3d"), (4, "plain day"), (5, ""), (6, None), (7, "rooootten")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in deobfuscate.score(probes, trained, ["doc_id"]).collect()}
    assert all(got[k] >= 0.3 for k in (1, 2, 3, 7)) and all(0 <= got[k] < 0.3 for k in (4, 5, 6))
    model = deobfuscate.CharModel(trained[2])
    assert model.decode("n4sty") == "nasty"


@pytest.mark.parametrize("noisy", ["i_d_i_o_t", "i d ! o t", "$ t u p i d", "i - d - i - o - t", "i  d  i  o  t", "stuupid", "st-up-id", "st up id", "id*ot", "id€ot".replace("€", "!"), "m€an", "y o u i d i o t", "you-1diot", "1d10t!", "s.t.u.p.i.d", "STUPIIID", "x" * 60 + "/stup1d"])
def test_op4_forms(noisy):
    r = random.Random(37)
    words = "you are so mean and that was an idiot or a stupid thing to do in the end of this long day but we meet a good friend".split()
    model = deobfuscate.CharModel(char_table(" ".join(r.choices(words, k=20_000))))
    found = {w for x in deobfuscate.restore(f"then {noisy}, there", model) for w in x.split()}
    assert found & {"idiot", "stupid", "mean"}, found
    assert not {"idiot", "stupid", "mean"} & set(deobfuscate.restore("a good friend, we meet in 2024 - 1,000 of us (at 10:30) to do it", model))


def test_op4_viterbi_is_the_best_path():
    """Every path through the lattice of short noisy strings."""
    r = random.Random(43)
    model = deobfuscate.CharModel(char_table(" ".join(r.choices("you idiot stupid mean did it to us all".split(), k=3000))))

    def paths(noisy, edges):
        held, prev, times = [((26, 26), 0.0)], "", 0
        for c in noisy.lower():
            times = times + 1 if c == prev else 1
            new = []
            for (a, b), score in held:
                for x, cost in model.options(c, times, edges):
                    k = deobfuscate._code(x) if x else None
                    new.append(((b, k), score + cost + model.log[a][b][k]) if x and not (x == " " and b == 26) else ((a, b), score + cost))
            held, prev = new, c
        return max(s + (model.log[a][b][26] if b != 26 else 0.0) for (a, b), s in held)

    for noisy in ("1d10t", "i.d.i", "$tuu", "y0u-1", "a!!", "1*d", "-", "m€@n", "il|1"):
        for edges in (False, True):
            if "*" not in noisy or edges:
                assert model.best(noisy, edges)[0] == pytest.approx(paths(noisy, edges))
    import time

    began = time.perf_counter()
    deobfuscate.restore("1d10t" * 20_000, model)
    assert time.perf_counter() - began < 60


def char_table(text):
    c = deobfuscate._CODE[np.frombuffer(b"\n" + text.encode() + b"\n", np.uint8)].astype(int)
    return np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3).astype(float)


def test_op4_scores_words_in_spaced_runs(spark):
    r = random.Random(17)
    bad = ["nasty", "rotten", "wicked"]
    rows = [(k, " ".join([word(r) for _ in range(20)] + ([r.choice(bad)] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    trained = deobfuscate.train(df, df, F.lit(True))
    forms = ["n_a_s_t_y", "n @ s t y", "r - o - t - t - e - n", "w  i  c  k  e  d", "na-st-y", "wickeed"]
    got = deobfuscate.score(spark.createDataFrame([(k, f"abc {x} defg") for k, x in enumerate(forms)], "doc_id long, text string"), trained, ["doc_id"]).collect()
    assert {forms[x.doc_id] for x in got if x.score < 0.3} == set()


def test_op4_and_op7_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for q, column in ((queries.op4_toxicity, "toxic"), (queries.op7_quality, "quality")):
        rows = q(spark, sf).join(labels, "doc_id").filter("held_out").select("score", column).collect()
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert auc > 0.95, (column, auc)


def test_held_out_labels_change_nothing(spark):
    r = random.Random(45)
    rows = [(k, " ".join(word(r) for _ in range(30)) + (" nasty rotten" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").select("doc_id", "text")
    for module, parts, which in ((ftrl, 5, 0), (deobfuscate, 4, 2)):
        out = lambda d: zlib.crc32(str(d).encode()) % parts == which
        same = [(d, y) for d, _, y in rows]
        turned = [(d, 1 - y if out(d) else y) for d, y in same] + [(10_000 + k, 1) for k in range(9000) if out(10_000 + k)]
        scores = []
        for labels in (same, turned):
            trained = module.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), ~queries._held_out(parts, which))
            scores.append({x.doc_id: x.score for x in module.score(docs, trained, ["doc_id"]).collect()})
        assert scores[0] == scores[1] and max(scores[0].values()) > 0.5


def test_op7_matches_plain_ftrl(monkeypatch):
    """Features and updates worked out with dictionaries, and hashing in chunks of any size."""
    import math
    import re

    r = random.Random(47)
    texts = [" ".join(r.choice(["a", "bb", "Cc", "7", "!?", "e\u0301", "bb", "x9"]) for _ in range(r.randint(0, 25))) for _ in range(40)] + ["", "ab" * 500]
    labels = [int("bb" in t) for t in texts]
    mul, mix, full = int(ftrl._MUL), int(ftrl._MIX), (1 << 64) - 1

    def plain(t):
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), re.sub(rb"[0-9]", b"0", t.encode()))
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)
        hs = []
        for w in found:
            h = sum((c + 1) * pow(mul, i, 1 << 64) for i, c in enumerate(w)) & full
            hs.append((h ^ h >> 31) * mix & full)
        twos = []
        for a, b in zip(hs, hs[1:]):
            p = (a * 0xC2B2AE3D27D4EB4F + b) & full
            twos.append((1 if a == b else p ^ p >> 29) * mix & full)
        return [x >> 44 for x in hs + twos]

    for chunk in (3, 64, 1 << 20):
        monkeypatch.setattr(ftrl, "CHUNK", chunk)
        ftrl._tables.cache_clear()
        index, starts = ftrl.features(texts)
        assert [sorted(index[a:b].tolist()) for a, b in zip(starts, starts[1:])] == [sorted(plain(t)) for t in texts]
    monkeypatch.undo()
    ftrl._tables.cache_clear()
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0)) <= 0.02:
            return 0.0
        return -(z[k] - math.copysign(0.02, z[k])) / ((1 + math.sqrt(n[k])) / 0.3 + 0.1)

    data = []
    for t in texts:
        own = plain(t)
        data.append({k: 30 * own.count(k) / max(len(own), 1) for k in own} | {1 << 20: 1.0})
    rng = np.random.default_rng(7)
    for _ in range(4):
        for j in rng.permutation(len(data)):
            w = {k: weight(k) for k in data[j]}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * x for k, x in data[j].items())))))
            for k, x in data[j].items():
                g = (p - labels[j]) * x
                s = (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / 0.3
                z[k], n[k] = z.get(k, 0) + g - s * w[k], n.get(k, 0) + g * g
    got = ftrl.fit(texts, labels)
    assert all(got[k] == pytest.approx(weight(k), abs=1e-5) for k in z) and np.count_nonzero(got) <= len(z)


def test_op7_empty_and_untrained(spark):
    w = ftrl.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, label int"), F.lit(True))
    got = ftrl.score(spark.createDataFrame([(None, None), (1, ""), (2, "a b c")], "doc_id long, text string"), w, ["doc_id"]).collect()
    assert [x.score for x in got] == [0.5] * 3


def test_op1_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1?x", "https://www.example.com/en/x", "http://b.net/es/", "http://b.net/fr", "http://net/fr/1#a", "http://x.org", "http://notexample.com/en/", "a://b://c/d"]
    got = url_tree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [x.rule for x in got] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, "com/", None]
    assert [(x.host, x.path) for x in got][-2:] == [("notexample.com", "/en/"), ("b:", "//c/d")]
    assert all(x.verdict in ("allow", "block") for x in got)
    assert url_tree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_op1_tree(spark, monkeypatch):
    """Deep paths, hosts without labels, merged siblings, hot paths, repeated rows, ties and other columns."""
    urls = [f"http://a.example.com/en/{k}/x/y/{k % 2}/end" for k in range(20)] + [f"http://b.example.com/{lang}/{k}" for lang in ("en", "de", "fr") for k in range(10)]
    urls += [f"http://q.org/en/{k}/x/y/{k % 2}/end" for k in range(6)] + [f"http://q.org/de/{k}" for k in range(6)] + ["http://q.org/" + "s/" * 3000] + [None] * 50 + ["http://q.org/same"] * 9
    df = spark.createDataFrame([(k, u, k) for k, u in enumerate(urls)], "page_id long, url string, n long").withColumn("t", F.lit(1)).withColumn("host", F.lit("z"))
    outs = []
    for hot in (100_000, 5):
        monkeypatch.setattr(url_tree, "HOT_ROWS", hot)
        got = {x.page_id: x for x in url_tree.judge(df).collect()}
        assert len(got) == len(urls)
        outs.append(got)
    assert outs[0] == outs[1]
    by = lambda text: {(x.template, x.verdict) for k, x in got.items() if urls[k] and text in urls[k]}
    assert by("a.example.com/en") == {("/en/*/x/y/0/end", "block"), ("/en/*/x/y/1/end", "block")} or by("a.example.com/en") == {("/en/*/x/y/0/end", "block")}
    assert {v for _, v in by("q.org/en")} == {"block"} and {v for _, v in by("q.org/de")} == {"allow"}  # by the prior over hosts
    assert len({t for t, _ in by("b.example.com/de") | by("b.example.com/fr")}) == 1 and len({t for t, _ in by("b.example.com/en") | by("b.example.com/de")}) == 2
    assert all(got[k].template == "" for k, u in enumerate(urls) if u is None)


def test_op10_text():
    page = """<html><head><title>t</title><script>var a="</p><article>";</script></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div>
    <article><h1>Head &amp; tail</h1><p>one <b>two<br>three<p>caf&eacute; &#8212;
    x</p><div class="comments"><p>me too</p></div><ul><li>a<li>b</ul></article><aside>side</aside><footer>&copy; us</footer>"""
    assert template.main_text(page, None) == "Head & tail\none two three\ncafé — x\na\nb"
    assert template.main_text("", None) == "" and template.main_text("<<p>>a<b", None)


def test_op10_template_slot(spark):
    r = random.Random(19)
    line = lambda n: " ".join(word(r) for _ in range(n))
    rows = [(k, "http://h.org/%d" % k, f"<body><div class=top><a href=x>{line(3)}</a></div><div class=left>{line(4)}</div><div class=cell><p>{line(40)}</p><p>tail {k}</p></div><div class=low>{line(3)}</div></body>") for k in range(6)]
    rows += [(90, None, None), (91, "http://h.org/x", ""), (None, "http://i.org/", "<p>alone</p>")]
    got = {x.page_id: x for x in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k].text.count("\n") == 1 and got[k].text.endswith(f"tail {k}") and got[k].n_chars == len(got[k].text)
    assert got[90].text == "" and got[91].text == "" and got[None].text == "alone"


def test_op10_slots_before_names(spark):
    """Names around the main slot, fixed text inside it, a section called related-work, an article that is not the slot."""
    r = random.Random(23)
    line = lambda n: " ".join(word(r) for _ in range(n))
    fixed, rows, want = "Read all of our terms before you copy this text", [], {}
    for k in range(8):
        t = [line(30), line(20), line(25), line(12)]
        rows.append((k, f"http://a.org/{k}", f'<body><div class="layout with-sidebar"><nav>menu</nav><article><h1>{t[3]}</h1><p>{t[0]}</p><section class="related-work"><p>{t[1]}</p></section><div class="hint">{fixed}</div><p>{t[2]} {fixed}</p><div class="comments"><p>{line(5)}</p></div></article></div></body>'))
        want[k] = "\n".join([t[3], t[0], t[1], t[2]])
        t = [line(40), line(30)]
        rows.append((20 + k, f"http://b.org/{k}", f"<body><article>teaser {line(3)}</article><div class=cell><p>{t[0]}</p><p>{t[1]}</p></div></body>"))
        want[20 + k] = "\n".join(t)
        rows.append((40 + k, f"http://c.org/{k % 2}", f"<body><div class=x><p>copies of {k % 2} stay whole and are no template</p></div></body>"))
        want[40 + k] = f"copies of {k % 2} stay whole and are no template"
    rows.append((60, "http://d.org/", '<body><div class="layout with-sidebar"><article><p>one page only</p></article></div></body>'))
    want[60] = "one page only"
    got = {x.page_id: x.text for x in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_op10_classes_match_a_plain_deduction(spark):
    """Classes by whole occurrence vectors, slots by their text, on small hosts."""
    r = random.Random(49)
    line = lambda n: " ".join(word(r) for _ in range(n))
    rows = []
    for h in range(5):
        shape = [r.choice(["div", "section", "article"]) for _ in range(3)]
        for k in range(6):
            body = "".join(f"<{t} class={"xyz"[j]}>" + "".join(f"<p>{line(r.randint(1, 30))}</p>" for _ in range(r.randint(1, 3) * (1 + 3 * (j == h % 3)))) + f"</{t}>" for j, t in enumerate(shape))
            rows.append((f"h{h}", f"<body><nav><a>{line(3)}</a></nav>{body}<footer>{line(2)}</footer></body>"))
    got = {x.host: x.main for x in template.deduce(spark.createDataFrame(rows, "host string, html string")).collect()}
    for h in {x for x, _ in rows}:
        pages = [template.parse(t) for x, t in rows if x == h]
        vectors = {}
        for k, p in enumerate(pages):
            for token, n in p.tokens.items():
                vectors.setdefault(token, [0] * len(pages))[k] = n
        classes = {}
        for token, v in vectors.items():
            classes.setdefault(tuple(v), []).append(token)
        valid = {t for v, c in classes.items() if len(c) >= 2 and sum(x > 0 for x in v) >= 3 and max(v) == 1 for t in c}
        held, info = {}, {}
        for p in pages:
            for k, node in enumerate(p.nodes):
                depth, up, inside = 0, k, set()
                while up > 0:
                    depth, up = depth + 1, p.nodes[up].parent
                info[node.path] = (node.called, depth, node.path, node.body)
            for at, text, linked in p.blocks:
                up, around = at, set()
                while up >= 0:
                    around.add(p.nodes[up].path)
                    up = p.nodes[up].parent
                if not (p.nodes[at].tagged or p.nodes[at].named):
                    for path in around:
                        held[path] = held.get(path, 0) + len(text) - 2 * min(linked, len(text))
        found = {t: held.get(t, 0) for t in valid if t in info and not info[t][3]}
        best = max(found.values(), default=0)
        assert got.get(h) == max((t for t, v in found.items() if v > 0 and v * 10 >= best * 9), key=lambda t: info[t][:3], default=None)


def test_op10_odd_pages(spark):
    """Deep and long markup, headings with chrome names, repeated rows, clashing columns, an empty table."""
    r = random.Random(51)
    line = lambda n: " ".join(word(r) for _ in range(n))
    rows, want = [], {}
    for k in range(6):
        t = [line(6), line(30), line(12), line(40)]
        rows.append((k, f"http://a.org/{k}", f'<body><article><h1 class="post-header">{t[0]}</h1><div class="entry-header"><h2>{t[2]}</h2></div><p>{t[1]}</p><div class="related-work">{t[3]}</div></article></body>'))
        want[k] = "\n".join([t[0], t[2], t[1], t[3]])
    rows += [(50, "http://deep.org/", "<div>" * 20_000 + "<b>" * 20_000 + "core" + "</i>" * 20_000), (51, "http://deep.org/", "<a " * 50_000 + 'x"' + "<p " * 50_000), (52, "http://deep.org/", "<p>" + "word " * 300_000 + "<!-- never closed"), *rows[:2]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t")).withColumn("main", F.lit("m"))
    got = template.extract(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    texts = {x.page_id: x.text for x in got}
    assert {k: texts[k] for k in want} == want
    assert texts[50] == "core" and texts[52] == ("word " * 300_000).strip()
    assert template.extract(df.limit(0)).count() == 0


def test_pipeline_keeps_rows_apart(spark):
    """Shared, null and repeated ids, leaks without an id, columns of any name, and empty tables in every stage."""
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, "alpha beta gamma delta one two three four five six"), (1, "totally other words that nobody else would ever write down here"), (None, "a row without an id but with some words"), (None, "a row without an id but with some words"), (2, None), (3, ""), (3, ""), (4, "word " * 30_000), (5, f"leak {item} leak"), (None, f"more {item} of it"), (5, "clean text that only shares its id with a leak, as it happens"), (6, "alpha beta gamma delta one two three four five six")]
    df = spark.createDataFrame([(d, t, 0.5, "x", 7, len(t or ""), "r") for d, t in rows], "doc_id long, text string, score double, `a.b` string, lines_removed int, n_chars long, row string")
    ids, now = {}, df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "bpe":
            assert out.columns == df.columns and {x.score for x in out.collect()} == {0.5}
            now = out
        ids[name] = sorted(((x.doc_id, x.text if name != "bpe" else None) for x in out.collect()), key=str)
        assert stage(spark, df.limit(0), SF).count() == 0
    key = lambda x: sorted(x, key=str)
    assert ids["toxicity"] == ids["line_dedup"] == key(rows)
    one_each = [x for x in rows if x[0] != 3 and x != rows[11]]
    one_each.remove(rows[2])
    assert ids["simhash_dedup"] == key(one_each)
    assert ids["decontaminate"] == key([x for x in one_each if not (x[1] and item in x[1])])
    assert len(ids["bpe"]) == len(ids["decontaminate"])


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in kept.collect()}
        kept = stage(spark, kept, SF)
        after = {x.doc_id: x for x in kept.collect()}
        assert set(after) <= set(before)
        if name != "bpe":
            assert kept.columns == columns
        if name == "simhash_dedup":
            want = {c for _, _, c in brute_groups([(d, x.text) for d, x in before.items()])}
            assert set(after) == want
        if name == "bpe":
            tok = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
            assert all(x.n_tokens == len(tok.encode(before[d].text or "", add_special_tokens=False).ids) for d, x in after.items())
    assert corpus_pipeline.run(spark, SF).count() == len(after)
