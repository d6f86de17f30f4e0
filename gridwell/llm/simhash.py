"""SimHash groups by the general pigeonhole principle.

Correlated bits are grouped into partitions, each query gets unequal per-partition radii from a dynamic program over
candidate counts, partition values are probed within those radii and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridwell.operators.components import connected_components
from gridwell.operators.joins import heavy_join
from gridwell.plans.runtime import materialize, partitions, quoted, small, tidy

RADIUS = 3
#: Rows of one probed value that a task compares with each other; larger ones are dealt to cells of block pairs.
BLOCK_ROWS = 4096


def fingerprint(text: str | None, size: int) -> int:
    """64 bits: a bit is 1 if set in over half the XXH64 (seed 42) of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, 42)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    hashes = np.array([h(joined[a:b], 42) for a, b in zip((end - length).tolist(), end[size - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[Column] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`) and fp of every row. Null and empty texts have fingerprint 0; shorter texts are one
    shingle, very long ones are summed in parts."""
    rows = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").alias("__text"))
    names, kinds = rows.columns[:-1], rows.dtypes[:-1]

    @tidy
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                got = np.array([fingerprint(t, shingle) for t in part.column(len(names)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(got.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds) + ", fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both; 64 x 64 sums reach the driver."""

    @tidy
    def run(batches):
        n, both = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            n, both = n + len(b), both + (b.T @ b).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(np.append(both.ravel(), n))], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for cell, n in sums:
        flat[cell] = n
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy groups of 64 // parts bits (the last ones one larger where that leaves a rest), most correlated first."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = set(range(64)), []
    sizes = [64 // parts + (k < 64 % parts) for k in range(parts)]
    for size in sizes:
        rest = sorted(left)
        seed = max(rest, key=lambda b: (sorted(corr[b, rest])[-size:-1] and sum(sorted(corr[b, rest])[-size:-1]), -b))
        own = [seed]
        while len(own) < size:
            own.append(max((b for b in rest if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        left -= set(own)
        out.append(sorted(own))
    return out


def _project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def radii(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Per query the radii (-1: don't probe) that sum to `total` at the least cost.

    costs[i][q, e + 1] is what query q pays for probing partition i within e. Dynamic program over partitions.
    """
    m, q, top = len(costs), len(costs[0]), costs[0].shape[1] - 2
    span = m + total + 1  # sums from -m to total
    best = np.full((q, span), np.inf)
    best[:, 0] = 0  # sum so far of the radii + 1, no partition yet
    took = np.zeros((m, q, span), np.int8)
    for i in range(m):
        new = np.full((q, span), np.inf)
        for e in range(-1, top + 1):
            step = e + 1
            cand = np.full((q, span), np.inf)
            cand[:, step:] = best[:, : span - step] + costs[i][:, [e + 1]]
            better = cand < new
            new[better], took[i][better] = cand[better], e
        best = new
    at, out, rows = np.full(q, span - 1), np.zeros((q, m), np.int8), np.arange(q)
    for i in range(m - 1, -1, -1):
        out[:, i] = took[i][rows, at]
        at = at - (out[:, i] + 1)
    return out


def plan_parts(n: int, radius: int = RADIUS) -> int:
    """Partitions at the least estimated probes and candidates of a query, if bits were even."""

    def cost(m: int) -> float:
        w, spare = 64 / m, radius - m + 1
        e = [max(0, spare // m + (k < spare % m)) for k in range(m)]
        balls = [sum(float(np.prod([(w - j) / (j + 1) for j in range(r)])) for r in range(x + 1)) for x in e]
        return sum(balls) + n * sum(b / 2**w for b in balls)

    return min(range(1, radius + 2), key=cost)


def links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within `radius` bits do. fps(fp): distinct ones.

    Every pair within the radius meets in a probed value, is verified there, and each task hands on a spanning
    forest of the verified pairs, not all of them. Values with over `block_rows` rows are dealt to pairs of blocks.
    """
    spark = fps.sparkSession
    n, both = co_occurrence(fps)
    m = parts or plan_parts(n, radius)
    groups = group_bits(n, both, m)
    total = radius - m + 1
    fold = [g[:16] for g in groups]  # candidate counts are kept for 2**16 values of a partition at most

    @tidy
    def counted(batches):
        sums = [np.zeros(1 << len(g), np.int64) for g in fold]
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, g in enumerate(fold):
                sums[k] += np.bincount(_project(v, g), minlength=len(sums[k]))
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["part", "value", "n"])

    hist = [np.zeros(1 << len(g)) for g in fold]
    for part, value, k in fps.select("fp").mapInArrow(counted, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toLocalIterator():
        hist[part][value] = k
    most = max(0, total + m - 1) if m > 1 else radius
    most = min(most, radius)
    shared = spark.sparkContext.broadcast(hist)

    @tidy
    def probes(batches):
        wide = [len(g) for g in groups]
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                raw = batch.column(0).slice(a, 20_000).to_numpy(zero_copy_only=False)
                v = raw.view(np.uint64)
                values, costs = [_project(v, g) for g in groups], []
                for i, g in enumerate(groups):
                    h, low, cost = shared.value[i], _project(v, fold[i]), np.zeros((len(v), most + 2))
                    seen, ball = np.zeros(len(v)), 0
                    for e in range(most + 1):
                        near = _masks(len(fold[i]), e)
                        ball += len(_masks(wide[i], e)) if wide[i] <= 22 or e < 3 else wide[i] ** e / 6
                        if e <= 1:
                            for x in near:
                                seen = seen + h[low ^ x]
                        else:
                            seen = seen * wide[i] / e
                        cost[:, e + 1] = seen / 2.0 ** (wide[i] - len(fold[i])) + ball
                    costs.append(cost)
                t = radii(costs, total)
                for i in range(m):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(values[i]), pa.array(raw), pa.array(np.ones(len(v), bool))], names=["part", "value", "fp", "own"])
                    for e in range(1, int(t[:, i].max(initial=0)) + 1):
                        at = np.flatnonzero(t[:, i] >= e)
                        near = _masks(wide[i], e)
                        for lo in range(0, len(near), 64):
                            some = near[lo : lo + 64]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) * len(some), i, np.int32)), pa.array((values[i][at][:, None] ^ some[None]).ravel()), pa.array(np.repeat(raw[at], len(some))), pa.array(np.zeros(len(at) * len(some), bool))], names=["part", "value", "fp", "own"])

    rows = fps.select("fp").mapInArrow(probes, "part int, value long, fp long, own boolean")
    rows = materialize(rows, "simhash-probes")
    hot = rows.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("part", "value", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    hot = materialize(hot, "simhash-hot")
    if hot.limit(1).count():
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = rows.join(small(hot), ["part", "value"], "left").withColumn("block", F.when(F.col("blocks").isNotNull(), block))
        other = F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
        rows = rows.withColumn("other", other).withColumn("cell", F.when(F.col("block").isNull(), F.lit(0)).otherwise(F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")))
    else:
        rows = rows.withColumn("cell", F.lit(0))

    def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning stars of the graph of links (a, b)."""
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            new = np.minimum(new, new[label])
            if np.array_equal(new, label):
                break
            label = new
        own = label != np.arange(len(nodes))
        return nodes[own], nodes[label[own]]

    def verify(key: np.ndarray, fp: np.ndarray, own: np.ndarray):
        """Links within runs of equal key; the pairs of all runs are compared lag by lag."""
        v, got, size, lag, at = fp.view(np.uint64), [], 0, 1, np.arange(len(fp) - 1)
        while len(at):
            at = at[(at + lag < len(fp))]
            at = at[key[at] == key[at + lag]]
            ok = at[(np.bitwise_count(v[at] ^ v[at + lag]) <= radius) & (own[at] | own[at + lag])]
            if len(ok):
                got.append((fp[ok], fp[ok + lag]))
                size += len(ok)
                if size > 1_000_000:
                    got = [forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))]
                    size = len(got[0][0])
            lag += 1
        return forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])) if got else None

    @tidy
    def compare(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[4] == held[4][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last run may go on
            if cut:
                ready, held = [x[:cut] for x in held], [x[cut:] for x in held]
                yield from out(ready)
        if held is not None and len(held[0]):
            yield from out(held)

    def out(cols):
        change = np.zeros(len(cols[0]), np.int64)
        change[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[4]) != 0)
        if (got := verify(np.cumsum(change), cols[2], cols[3])) is not None and len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    keys = ["part", "value", "cell"]
    dealt = rows.select("part", "value", "fp", "own", F.col("cell").cast("long").alias("cell")).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "a long, b long")


def classes(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, root) of every distinct fingerprint of fps(fp): root is one fingerprint of its class."""
    reps = materialize(fps.select("fp").distinct(), "simhash-distinct")
    found = connected_components(links(reps, radius, parts, block_rows))
    return reps.join(found, reps.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, parts: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Equal fingerprints link, empty texts (fingerprint 0) like any other. Null doc_ids take part in links but are never
    the smallest; a group of null doc_ids alone has a null component_id. Repeated rows stay. An empty table gives none.
    """
    fps = materialize(fingerprints(docs, shingle), "simhash-fp")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = materialize(classes(fps, radius, parts, block_rows).join(low, "fp"), "simhash-classes")
    named = materialize(joined.join(joined.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id"), "simhash-named")
    return heavy_join(fps, named, ["fp"], ["doc_id"], block_rows).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of each group of docs(doc_id, text, ...), with all its columns.

    It is the one with the smallest doc_id (null last), then the smallest hash of its text and of its row. Rows with one
    doc_id and other texts are rows of their own; of rows that agree in every column one stays.
    """
    names = docs.columns
    key = [F.col("doc_id").isNull().alias("k0"), F.col("doc_id").cast("long").alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64(*[quoted(c) for c in names]).alias("k3")]
    counts = fingerprints(docs, shingle, key).groupBy("fp", "k0", "k1", "k2", "k3").agg(F.count("*").alias("n"))
    rows = materialize(counts, "simhash-rows")
    # only the least row of a fingerprint joins its class, and rows join by their own key: no group of copies is one key
    low = rows.groupBy("fp").agg(F.min(F.struct("k0", "k1", "k2", "k3")).alias("low"))
    first = classes(rows, radius).join(low, "fp").groupBy("root").agg(F.min("low").alias("first"))
    first = materialize(first.select(*[F.col(f"first.k{k}").alias(f"f{k}") for k in range(4)], F.lit(True).alias("stays")), "simhash-first")
    same = (F.col("f0") == F.col("k0")) & F.col("f1").eqNullSafe(F.col("k1")) & (F.col("f2") == F.col("k2")) & (F.col("f3") == F.col("k3"))
    told = rows.join(first, same, "left").select("k0", "k1", "k2", "k3", "n", "stays")
    told = materialize(told.filter("stays is null or n > 1"), "simhash-told")
    at = lambda df: (F.col("o0") == F.col("k0")) & F.col("o1").eqNullSafe(F.col("k1")) & (F.col("o2") == F.col("k2")) & (F.col("o3") == F.col("k3"))
    own = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), *[c.alias(f"o{k}") for k, c in enumerate(key)])
    gone = told.filter("stays is null").drop("n", "stays")
    left = own.join(small(gone), at(gone), "left_anti")
    again = told.filter("stays").drop("n", "stays")
    if again.limit(1).count():  # rows that are equal in every column
        again = small(again)
        once = left.join(again, at(again), "left_semi").dropDuplicates(["o0", "o1", "o2", "o3"])
        left = left.join(again, at(again), "left_anti").unionByName(once)
    return left.select("row.*")
