"""MinHash signatures, bands and candidate pairs of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwell.functions.mod64 import affine, signed, unsigned_min
from gridwell.operators.joins import heavy_join
from gridwell.operators.matrix import SCAN_BUCKET, Matrix
from gridwell.plans.runtime import by_kind, materialize, partitions, small, tidy

# The congruential generator that gives the coefficients, and the bounds of a bucket's pairs.
LCG_MUL, LCG_ADD = 6364136223846793005, 1442695040888963407
BUCKET_LIMIT, WINDOW_ROWS = 256, 16
#: Rows of a large bucket that one task pairs.
RUN_ROWS = 1 << 16
#: Rows of a block of signatures that a task holds two of to score pairs.
SCORE_ROWS = 1 << 16


def coefficients(k: int, seed: int = 12345) -> list[tuple[int, int]]:
    """k pairs (a odd, b) from the generator started at the seed."""
    out, state = [], seed
    step = lambda s: (s * LCG_MUL + LCG_ADD) & ((1 << 64) - 1)
    for _ in range(k):
        state = step(state)
        a = state | 1
        state = step(state)
        out.append((a, state))
    return out


def signatures(m: Matrix, k: int = 64, seed: int = 12345) -> DataFrame:
    """(i, sig array<long>) of every row: per coefficient pair the least unsigned a j + b; an empty row has all ones.

    One aggregation with map-side minima: what is shuffled is a signature a row and task, not the entries.
    """
    coef = coefficients(k, seed)
    held = m.entries.groupBy("i").agg(*[unsigned_min(affine(a, b, F.col("j"), m.ncols > 1 << 31)).alias(f"h{d}") for d, (a, b) in enumerate(coef)])
    empty = F.array_repeat(F.lit(signed(-1)), k)
    own = held.select("i", F.array(*[f"h{d}" for d in range(k)]).alias("sig"))
    return m.rows().join(own, "i", "left").select("i", F.coalesce("sig", empty).alias("sig"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 for empty ones or unequal sizes."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def bands(sigs: DataFrame, k: int, n: int) -> DataFrame:
    """(i, band, part): the signature cut into n bands; none if n does not divide k. A band's part is its bucket."""
    if n < 1 or k % n:
        return sigs.select("i", F.lit(0).alias("band"), F.col("sig").alias("part")).limit(0)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.slice("sig", b * (k // n) + 1, k // n))
    return sigs.select("i", F.posexplode(cut).alias("band", "part"))


def _run_pairs(banded: DataFrame, window: int) -> DataFrame:
    """(i, j): each row of a bucket with its next `window` rows.

    Rows are numbered over cells of row ids and cut into runs of RUN_ROWS, to which the first `window` rows of the next
    run are copied: a bucket of any size is as many tasks' work as it has runs.
    """
    cell = F.floor(F.col("i") / SCAN_BUCKET)
    placed = banded.withColumn("cell", cell)
    sizes = placed.groupBy("band", "part", "cell").agg(F.count("*").alias("size"))
    base = sizes.withColumn("base", F.sum("size").over(Window.partitionBy("band", "part").orderBy("cell")) - F.col("size")).drop("size")
    at = F.row_number().over(Window.partitionBy("band", "part", "cell").orderBy("i")) - 1
    held = placed.withColumn("at", at).join(base, ["band", "part", "cell"]).withColumn("at", F.col("base") + F.col("at")).withColumn("run", F.floor(F.col("at") / RUN_ROWS))
    runs = F.when((F.col("run") > 0) & (F.col("at") % RUN_ROWS < window), F.array("run", F.col("run") - 1)).otherwise(F.array("run"))
    dealt = held.select("band", "part", "i", "at", F.col("run").alias("home"), F.explode(runs).alias("run"))
    ahead = F.collect_list("i").over(Window.partitionBy("band", "part", "run").orderBy("at").rowsBetween(1, window))
    return dealt.withColumn("next", ahead).filter("home = run").select("i", F.explode("next").alias("j"))


def bucket_pairs(banded: DataFrame, limit: int | None = None, window: int = WINDOW_ROWS) -> DataFrame:
    """Distinct (i, j), i < j, of rows that share a bucket, by a join that deals buckets of many pairs to several tasks.

    limit, only where it is asked for: in buckets of over `limit` rows each row meets its next `window` instead.
    """
    if limit is None:
        shared = banded.groupBy("band", "part").agg(F.count("*").alias("n")).filter("n > 1").select("band", "part")
        banded = materialize(banded.join(shared, ["band", "part"], "left_semi"), "lsh-shared")
        return heavy_join(banded, banded.select("band", "part", F.col("i").alias("j")), ["band", "part"], ["i"]).filter("i < j").select("i", "j").distinct()
    large = banded.groupBy("band", "part").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("band", "part")
    rest, out = banded, None
    if large.limit(1).count():
        large = small(materialize(large, "lsh-buckets"))
        rest, out = banded.join(large, ["band", "part"], "left_anti"), _run_pairs(banded.join(large, ["band", "part"]), window)
    # a small bucket is one row; its pairs are unfolded in place
    ids = rest.groupBy("band", "part").agg(F.sort_array(F.collect_list("i")).alias("ids")).filter(F.size("ids") > 1)
    first = ids.select(F.posexplode("ids").alias("at", "i"), "ids").filter(F.col("at") + 1 < F.size("ids"))
    pairs = first.select("i", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("j"))
    return (pairs if out is None else pairs.unionByName(out)).distinct()


def _packed(sigs: DataFrame, k: int, seed: int, ncols: int) -> DataFrame:
    """(i, sig binary): places of equal value have equal bytes. Each place's numbers are a permutation, so the column that
    gave the minimum stands for it, in 4 bytes where columns fit; the all ones of an empty row become -1 unless a column
    has them too."""
    if ncols > 1 << 31:
        turn = lambda v: v
        kind = np.int64
    else:
        mul, add = (np.array([f(a, b) for a, b in coefficients(k, seed)], np.uint64) for f in (lambda a, b: pow(a, -1, 1 << 64), lambda a, b: b))
        kind = np.int32

        def turn(v):
            col = (v.view(np.uint64) - add) * mul
            return np.where(col < np.uint64(1 << 31), col, np.uint64((1 << 64) - 1)).view(np.int64)

    @tidy
    def run(batches):
        for batch in batches:
            values = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, k)
            out = np.ascontiguousarray(turn(values), kind)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([x.tobytes() for x in out], pa.binary())], names=["i", "sig"])

    return sigs.mapInArrow(run, "i long, sig binary")


def _scored(m: Matrix, sigs: DataFrame, pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """(i, j, score) of pairs, i < j. Pairs are dealt by the blocks of their rows, and a block's signatures go to the tasks of
    its pairs of blocks once, not with each pair."""
    kind, n = (np.int64 if m.ncols > 1 << 31 else np.int32), -(-m.nrows // SCORE_ROWS)
    block = lambda c: F.floor(F.col(c) / SCORE_ROWS)
    packed = _packed(sigs, k, seed, m.ncols).withColumn("own", block("i"))
    none = {"j": F.lit(None).cast("long"), "kind": F.lit(0)}
    left = packed.withColumns({**none, "to": F.explode(F.sequence(F.col("own"), F.lit(n - 1).cast("long")))}).withColumn("part", F.col("own") * n + F.col("to"))
    right = packed.filter("own > 0").withColumns({**none, "kind": F.lit(1), "to": F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))}).withColumn("part", F.col("to") * n + F.col("own"))
    told = pairs.withColumns({"part": block("i") * n + block("j"), "kind": F.lit(2), "sig": F.lit(None).cast("binary")})
    shape = ["part", "kind", "i", "j", "sig"]
    every = left.select(shape).unionByName(right.select(shape)).unionByName(told.select(shape))

    @tidy
    def run(batches):
        for _, held in by_kind(batches):
            sides = []
            for side in (0, 1):
                one = np.zeros((0, k), kind)
                for batch in held.of(side):
                    if not len(one):
                        one = np.zeros((SCORE_ROWS, k), kind)
                    one[batch.column("i").to_numpy() % SCORE_ROWS] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), kind).reshape(-1, k)
                sides.append(one)
            a, b = sides[0], sides[1] if len(sides[1]) else sides[0]
            for batch in held.of(2):
                i, j = batch.column("i"), batch.column("j").cast(pa.int64())
                same = np.count_nonzero(a[i.to_numpy() % SCORE_ROWS] == b[j.to_numpy() % SCORE_ROWS], axis=1)
                yield pa.RecordBatch.from_arrays([i, j, pa.array(same / k)], names=["i", "j", "score"])

    dealt = every.repartition(partitions(sigs.sparkSession), "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(run, "i long, j long, score double")


def packed_signatures(m: Matrix, k: int = 64, seed: int = 12345) -> DataFrame:
    """(i, sig binary): `signatures` as bytes, equal where places are equal."""
    return _packed(signatures(m, k, seed), k, seed, m.ncols)


class Buckets:
    """All pairs of rows that share one of n bands of k places, without forming them. sigs: `packed_signatures`."""

    def __init__(self, sigs: DataFrame, k: int, n: int, ncols: int):
        self.sigs, self.k, self.kind = sigs, k, (np.int64 if ncols > 1 << 31 else np.int32)
        self.n = n if n > 0 and k % n == 0 else 0  # no bands if n does not divide k

    def banded(self) -> DataFrame:
        """(i, band, part): as `bands`, a part as bytes."""
        if not self.n:
            return self.sigs.select("i", F.lit(0).alias("band"), F.col("sig").alias("part")).limit(0)
        size = self.k // self.n * np.dtype(self.kind).itemsize
        return self.sigs.select("i", F.posexplode(F.array(*[F.substring("sig", b * size + 1, size) for b in range(self.n)])).alias("band", "part"))

    def frame(self) -> DataFrame:
        """The pairs (i, j), i < j, formed."""
        return bucket_pairs(self.banded(), None)

    def count(self) -> int:
        return self.frame().count()

    def links(self) -> DataFrame:
        """(i, j), j < i, that connect the rows of each bucket and no others; a row of no pair has none.

        A row is linked to the first of its bucket and cell of row ids, and that to the bucket's first: no task has all
        rows of a large bucket.
        """
        placed = self.banded().withColumn("cell", F.floor(F.col("i") / SCAN_BUCKET))
        first = lambda *by: F.min("i").over(Window.partitionBy("band", "part", *by))
        cells = placed.groupBy("band", "part", "cell").agg(F.min("i").alias("i"))
        near, far = placed.withColumn("j", first("cell")), cells.withColumn("j", first())
        return near.select("i", "j").unionByName(far.select("i", "j")).filter("i > j").distinct()


def candidates(m: Matrix, k: int = 64, n: int = 16, seed: int = 12345, limit: int | None = None, window: int = WINDOW_ROWS, sigs: DataFrame | None = None) -> DataFrame:
    """(i, j, score) of candidate pairs, score the estimated similarity. Signatures are written once.

    sigs: signatures of the rows to pair, where the caller has written them. Where the blocks of signatures would be more than the signatures of each pair, these go with the pairs instead.
    """
    sigs = materialize(signatures(m, k, seed), "lsh-signatures") if sigs is None else sigs
    pairs = materialize(bucket_pairs(bands(sigs, k, n), limit, window), "lsh-pairs")
    if -(-m.nrows // SCORE_ROWS) * m.nrows <= max(2 * pairs.count(), 2 * m.nrows):
        return _scored(m, sigs, pairs, k, seed)
    left, right = sigs.select("i", F.col("sig").alias("a")), sigs.select(F.col("i").alias("j"), F.col("sig").alias("b"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", estimated_jaccard(F.col("a"), F.col("b")).alias("score"))
