"""Greedy clustering of rows from candidate pairs, one component of the pair graph at a time."""

from __future__ import annotations

import bisect
import heapq
import tempfile
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridwell.operators import lsh
from gridwell.operators.best_first import BestFirst
from gridwell.operators.components import connected_components
from gridwell.operators.matrix import SCAN_BUCKET, Matrix, prefix_sum
from gridwell.plans.runtime import Kinds, by_kind, materialize, partitions, small, tidy

CAP = 8


class _Forest:
    """Roots by union-find."""

    def __init__(self, n: int):
        self.parent, self.sizes = array("q", range(n)), [1] * n

    def roots_of(self, rows: np.ndarray) -> np.ndarray:
        parent = np.frombuffer(self.parent, np.int64)
        tops, above = rows, parent[rows]
        while (tops != above).any():
            tops, above = above, parent[above]
        return tops

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def size(self, x: int) -> int:
        return self.sizes[x]

    def merge(self, keep: int, gone: int) -> int:
        self.parent[gone] = keep
        self.sizes[keep] += self.sizes[gone]
        return self.sizes[keep]


class _Members:
    """Roots by lists: each root keeps its members, who are told their new root when it changes."""

    def __init__(self, n: int):
        self.roots, self.held = array("q", range(n)), {}

    def roots_of(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.roots, np.int64)[rows]

    def root(self, x: int) -> int:
        return self.roots[x]

    def size(self, x: int) -> int:
        return len(self.held.get(x, (x,)))

    def merge(self, keep: int, gone: int) -> int:
        own, more = self.held.setdefault(keep, [keep]), self.held.pop(gone, [gone])
        for x in more:
            self.roots[x] = keep
        own += more
        return len(own)


class _Heap:
    """Waiting pairs in a heap."""

    def __init__(self):
        self.pairs = []

    def first(self):
        return self.pairs[0] if self.pairs else None

    def pop(self):
        return heapq.heappop(self.pairs)

    def push(self, pair) -> None:
        heapq.heappush(self.pairs, pair)


class _Runs:
    """Waiting pairs in sorted runs of bounded length, the first pair last."""

    MOST = 2000

    def __init__(self):
        self.runs, self.ends = [], []  # ends: the last pair of each run, negated like its run

    def first(self):
        return tuple(-x for x in self.runs[-1][-1]) if self.runs else None

    def pop(self):
        out = self.runs[-1].pop()
        if self.runs[-1]:
            self.ends[-1] = self.runs[-1][-1]
        else:
            del self.runs[-1], self.ends[-1]
        return tuple(-x for x in out)

    def push(self, pair) -> None:
        pair = tuple(-x for x in pair)
        if not self.runs:
            self.runs, self.ends = [[pair]], [pair]
            return
        k = min(bisect.bisect_left(self.ends, pair), len(self.runs) - 1)
        run = self.runs[k]
        bisect.insort(run, pair)
        if len(run) > self.MOST:
            half = len(run) // 2
            self.runs[k : k + 1] = [run[:half], run[half:]]
            self.ends[k : k + 1] = [run[half - 1], run[-1]]
        else:
            self.ends[k] = run[-1]


#: How a component's task keeps its books: who is whose root, and which pairs wait. The roots found are the same.
BOOKS = {"heap": (_Forest, _Heap), "members": (_Members, _Runs)}


def _merge_all(stream, n: int, given, similarity, cap: int, strategy: str) -> list[int]:
    """Root of each of n rows. stream: (-score, -(i * n + j)) of every pair, ascending; or a function that gives it from
    the roots and the closed rows so far, and may leave out pairs that can change nothing any more.

    Pairs are taken by score, then by the larger ids. Two open roots merge, the smaller into the larger (ties into the
    first); a root that reaches `cap` closes. A pair of rows that are roots no longer hands its roots on with their exact
    similarity, once, unless that pair is given(i * n + j) too. Only handed-on pairs wait here: the given ones come in
    order, and what is known of a root goes when it closes or ends.
    """
    forest, queue = BOOKS[strategy]
    forest, queue = forest(n), queue()
    root, known, closed = forest.root, {}, bytearray(n)
    if callable(stream):
        stream = stream(forest, np.frombuffer(closed, bool))
    ahead = next(stream, None)
    while True:
        first = queue.first()
        if first is not None and (ahead is None or first < ahead):
            pair = queue.pop()
        elif ahead is not None:
            pair, ahead = ahead, next(stream, None)
        else:
            break
        i, j = divmod(-pair[1], n)
        a, b = root(i), root(j)
        if a == b or closed[a] or closed[b]:
            continue
        if a == i and b == j:
            keep, gone = (j, i) if forest.size(j) > forest.size(i) else (i, j)
            known.pop(gone, None)
            if forest.merge(keep, gone) >= cap:
                closed[keep] = 1
                known.pop(keep, None)
            continue
        a, b = min(a, b), max(a, b)
        told = known.setdefault(a, set())
        if b not in told:
            told.add(b)
            if not given(a * n + b):
                queue.push((-similarity(a, b), -(a * n + b)))
    return [root(x) for x in range(n)]


def _agglomerate(pairs: list[tuple[int, int, float]], rows: dict[int, set], cap: int, strategy: str) -> dict[int, int]:
    ids = sorted({x for i, j, _ in pairs for x in (i, j)})
    at, n = {x: k for k, x in enumerate(ids)}, len(ids)
    waiting = sorted((-s, -(at[i] * n + at[j])) for i, j, s in pairs)
    given = {-key for _, key in waiting}

    def similarity(a: int, b: int) -> float:
        x, y = rows.get(ids[a], set()), rows.get(ids[b], set())
        both = len(x & y)
        return both / (len(x) + len(y) - both) if x or y else 0.0

    return {ids[x]: ids[r] for x, r in enumerate(_merge_all(iter(waiting), n, given.__contains__, similarity, cap, strategy))}


def agglomerate(pairs: list[tuple[int, int, float]], rows: dict[int, set], cap: int = CAP) -> dict[int, int]:
    """Root of every row in `pairs`, by union-find and a heap of pairs."""
    return _agglomerate(pairs, rows, cap, "heap")


def agglomerate_by_members(pairs: list[tuple[int, int, float]], rows: dict[int, set], cap: int = CAP) -> dict[int, int]:
    """What `agglomerate` finds, by lists of members and sorted runs of pairs."""
    return _agglomerate(pairs, rows, cap, "members")


STRATEGIES = {"heap": agglomerate, "members": agglomerate_by_members}


class _File:
    """Numbers of one type in a file of this task's own, read through the page cache; the file has no name any more."""

    def __init__(self):
        self.file, self.kind, self.n = tempfile.TemporaryFile(), np.dtype(np.int64), 0

    def add(self, values: np.ndarray) -> None:
        self.kind = values.dtype if not self.n else self.kind
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.n += len(values)

    def read(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,)) if self.n else np.zeros(0, self.kind)


def _rows(held: Kinds):
    """(ids, exact similarity of two rows, bytes of the signatures if they have come) of a component's rows. Columns and
    signatures lie in files."""
    ids, sizes, cols, sigs = [], [], _File(), _File()
    for batch in held.of(0):
        own = batch.column("cols")
        ids.append(batch.column("i").to_numpy())
        sizes.append(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        cols.add(own.flatten().to_numpy())
        if "sig" in batch.schema.names:
            sigs.add(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8))
    start, cols = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64)), cols.read()

    def similarity(a: int, b: int) -> float:
        x, y = cols[start[a] : start[a + 1]], cols[start[b] : start[b + 1]]
        if len(x) < len(y):
            x, y = y, x
        both = int(np.count_nonzero(x.take(x.searchsorted(y), mode="clip") == y)) if len(y) else 0
        return both / (len(x) + len(y) - both) if len(x) else 0.0

    return np.concatenate(ids), similarity, sigs.read()


def _component(held: Kinds, cap: int, strategy: str) -> pa.RecordBatch:
    """(i, root) of one component, whose kinds are its rows, its pairs for look-up and its pairs in order.

    The columns of the rows and the pairs for look-up are in files: this worker's memory holds an offset and a few numbers
    a row, and the pairs that are handed on.
    """
    ids, similarity, _ = _rows(held)
    n = len(ids)
    keys = _File()
    key = lambda i, j: np.searchsorted(ids, i) * n + np.searchsorted(ids, j)
    for batch in held.of(1):
        keys.add(key(batch.column("i").to_numpy(), batch.column("j").to_numpy()))
    keys = keys.read()
    look = memoryview(keys) if len(keys) else []

    def given(x: int) -> bool:
        at = bisect.bisect_left(look, x)
        return at < len(look) and look[at] == x

    def stream():
        for batch in held.of(2):
            yield from zip(batch.column("s").to_numpy().tolist(), (-key(-batch.column("i").to_numpy(), -batch.column("j").to_numpy())).tolist())

    roots = _merge_all(stream(), n, given, similarity, cap, strategy)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[np.array(roots)])], names=["i", "root"])


def _bucket_component(held: Kinds, bands: int, k: int, kind: type, cap: int, strategy: str) -> pa.RecordBatch:
    """(i, root) of one component, whose only kind is its rows, with their signatures.

    Pairs are formed here, best first, and only as many at once as BestFirst holds. Closed rows leave its buckets, and of
    the pairs that it gives those of one root or of a closed one are not looked at one by one.
    """
    ids, similarity, sigs = _rows(held)
    n, best = len(ids), BestFirst(np.asarray(sigs).view(kind).reshape(-1, k), bands)

    def stream(forest, closed):
        for places, i, j in best.pairs(lambda: ~closed[forest.roots_of(np.arange(n))]):
            a, b = forest.roots_of(i), forest.roots_of(j)
            live = np.flatnonzero((a != b) & ~closed[a] & ~closed[b])
            yield from zip((-(places[live] / k)).tolist(), (-(i[live] * n + j[live])).tolist())

    roots = _merge_all(stream, n, lambda key: best.share(*divmod(key, n)), similarity, cap, strategy)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[np.array(roots)])], names=["i", "root"])


def row_sets(m: Matrix) -> DataFrame:
    """(i, cols) of rows with entries: their columns, ascending and once each, as ints where they fit."""
    column = "int" if m.ncols <= 1 << 31 else "bigint"
    return m.entries.select("i", F.col("j").cast(column).alias("j")).groupBy("i").agg(F.sort_array(F.collect_set("j")).alias("cols"))


def hierarchical(m: Matrix, pairs: DataFrame | lsh.Buckets, cap: int = CAP, strategy: str = "heap", sets: DataFrame | None = None) -> DataFrame:
    """(i, root) of every row; rows in no pair are their own root. pairs(i, j, score), i < j.

    Merges never leave a connected component of the pairs, so components are found first and clustered in parallel; a
    component is one task's work, which is what the sequential rule allows. A task gets a component's rows, its pairs for
    look-up and its pairs in order, as batches of one sorted partition, and holds none of them as a whole. strategy says
    how that task keeps its books (BOOKS): "heap" or "members"; both give the same roots. sets: row_sets(m), where the caller has them.

    pairs may be lsh.Buckets: all pairs of their buckets, with estimated similarities, which no frame holds; components
    come from links in the buckets, and a task gets signatures with its rows.
    """
    sets = row_sets(m) if sets is None else sets
    if isinstance(pairs, lsh.Buckets):
        merged = _of_buckets(m, pairs, cap, strategy, sets)
    else:
        merged = _of_pairs(m, pairs, cap, strategy, sets)
    return m.rows().join(materialize(merged, "hc-roots"), "i", "left").select("i", F.coalesce("root", "i").alias("root"))


def _components(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links, "i", "j"), "hc-components").select(F.col("node").alias("i"), F.col("component").alias("part"))


def _of_buckets(m: Matrix, pairs: lsh.Buckets, cap: int, strategy: str, sets: DataFrame) -> DataFrame:
    cells = _components(pairs.links()).join(pairs.sigs, "i").join(sets, "i", "left").withColumn("kind", F.lit(0))
    dealt = cells.select("part", "kind", "i", "cols", "sig").repartition(partitions(m.entries.sparkSession), "part").sortWithinPartitions("part", "i")
    bands, k, kind = pairs.n, pairs.k, pairs.kind

    @tidy
    def run(batches):
        for _, held in by_kind(batches):
            yield _bucket_component(held, bands, k, kind, cap, strategy)

    return dealt.mapInArrow(run, "i long, root long")


def _of_pairs(m: Matrix, pairs: DataFrame, cap: int, strategy: str, sets: DataFrame) -> DataFrame:
    pairs = materialize(pairs.groupBy("i", "j").agg(F.max("score").alias("score")), "hc-pairs")
    found = _components(pairs)
    cells = found.join(sets, "i", "left")
    own = pairs.join(found, "i")
    none = {"s": F.lit(None).cast("double"), "cols": F.lit(None).cast(sets.schema["cols"].dataType)}
    shape = ["part", "kind", "s", "i", "j", "cols"]
    kinds = [
        cells.withColumns({"kind": F.lit(0), "s": none["s"], "j": F.lit(None).cast("long")}),
        own.withColumns({"kind": F.lit(1), **none}),
        own.withColumns({"kind": F.lit(2), "s": F.lit(0.0) - F.col("score"), "i": -F.col("i"), "j": -F.col("j"), "cols": none["cols"]}),
    ]
    every = kinds[0].select(shape).unionByName(kinds[1].select(shape)).unionByName(kinds[2].select(shape))
    dealt = every.repartition(partitions(m.entries.sparkSession), "part").sortWithinPartitions(*shape[:5])

    @tidy
    def run(batches):
        for _, held in by_kind(batches):
            yield _component(held, cap, strategy)

    return dealt.mapInArrow(run, "i long, root long")


def permutation(clusters: DataFrame, nrows: int) -> tuple[DataFrame, DataFrame]:
    """((new_row, old_row), (cluster, start, stop)): clusters by root, rows ascending inside."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    starts = prefix_sum(sizes, "root", "n", "start")
    inside = F.row_number().over(Window.partitionBy("root").orderBy("i")) - 1
    perm = clusters.withColumn("at", inside).join(starts, "root").select((F.col("start") + F.col("at")).alias("new_row"), F.col("i").alias("old_row"))
    numbered = prefix_sum(sizes.withColumn("one", F.lit(1)), "root", "one", "cluster")
    offsets = starts.join(numbered.select("root", "cluster"), "root").select("cluster", "start", (F.col("start") + F.col("n")).alias("stop"))
    return perm, offsets


def settle_copies(sigs: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """((i, sig) of the rows that are still open, (i, root) of those that are settled), where every pair of rows of equal
    signatures is given with a score of 1.

    These pairs come before all others, the largest ids first, and meet no other rows: from the largest id on, each `cap`
    rows close as one cluster whose root is the second largest of them. Closed rows change nothing after that, so that
    only the pairs of the rest, fewer than `cap` rows of the lowest ids of each signature, are needed. Rows are numbered
    over cells of row ids: a signature of very many rows is no single task's work.
    """
    size, same = max(cap, 2), ["c0", "c1"]
    told = sigs.select("i", *[F.xxhash64(F.lit(k), "sig").alias(c) for k, c in enumerate(same)], F.floor(F.col("i") / SCAN_BUCKET).alias("cell"))
    cells = told.groupBy(*same, "cell").agg(F.count("*").alias("n"))
    rows = materialize(cells.groupBy(*same).agg(F.sum("n").alias("rows")).filter(F.col("rows") >= size), "hc-copies")
    large = cells.join(small(rows), same)
    base = large.withColumn("base", F.sum("n").over(Window.partitionBy(*same).orderBy("cell")) - F.col("n")).drop("n")
    at = F.row_number().over(Window.partitionBy(*same, "cell").orderBy("i")) - 1 + F.col("base")
    placed = told.join(small(base), [*same, "cell"]).withColumn("before", F.col("rows") - 1 - at)
    closed = placed.filter(F.col("before") < F.col("rows") - F.col("rows") % size)
    groups = closed.groupBy(*same, F.floor(F.col("before") / size).alias("group")).agg(F.sort_array(F.collect_list("i")).alias("ids"))
    settled = materialize(groups.select(F.explode("ids").alias("i"), F.element_at("ids", F.lit(-2)).alias("root")), "hc-settled")
    return materialize(sigs.join(settled, "i", "left_anti"), "lsh-open"), settled


def read_once(m: Matrix) -> tuple[Matrix, DataFrame]:
    """m with its rows written, and row_sets of it: what the entries are made from is read once. Values become 1."""
    sets = materialize(row_sets(m), "hc-rows", "zstd")
    return m.with_entries(sets.select("i", F.explode("cols").alias("j")).select("i", F.col("j").cast("long").alias("j"), F.lit(1.0).alias("v"))), sets


def preprocess(m: Matrix, k: int = 64, n: int = 16, seed: int = 7, cap: int = CAP, capped: bool = False, strategy: str = "heap", sets: DataFrame | None = None, sigs: DataFrame | None = None) -> DataFrame:
    """(i, root): signatures, candidate pairs and greedy clustering. All pairs of every bucket count, unless `capped` asks
    for those of capped buckets.

    Of all pairs, those of copies that `settle_copies` settles are not looked at, and none is written; the roots are the same.
    sets, sigs: read_once's sets and lsh.packed_signatures, where the caller has written both; m is then read_once's matrix.
    """
    own, sets = read_once(m) if sets is None else (m, sets)
    if capped:
        return hierarchical(own, lsh.candidates(own, k, n, seed, lsh.BUCKET_LIMIT), cap, strategy, sets)
    if n < 1 or k % n:
        return m.rows().select("i", F.col("i").alias("root"))
    sigs = materialize(lsh.packed_signatures(own, k, seed), "lsh-signatures") if sigs is None else sigs
    sigs, settled = settle_copies(sigs, cap)
    roots = hierarchical(own, lsh.Buckets(sigs, k, n, own.ncols), cap, strategy, sets)
    return roots.join(settled.withColumnRenamed("root", "settled"), "i", "left").select("i", F.coalesce("settled", "root").alias("root"))
