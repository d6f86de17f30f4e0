"""C = A B as a join and an aggregation, in row-wise and clustered forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridwell.operators import work
from gridwell.operators.joins import HEAVY_ROWS, heavy_join
from gridwell.operators.matrix import Matrix, prefix_sum
from gridwell.operators.work import deal, gather
from gridwell.plans.runtime import Kinds, by_kind, materialize, partitions, small, tidy

#: Columns up to which a dense row accumulator is used, rows of a block and cells of it at most.
SPA_COLUMNS, SPA_ROWS, SPA_CELLS = 1 << 20, 128, 1 << 22
#: Columns of a piece of a row of B, and products that are formed at once.
PIECE_COLUMNS, FLUSH_PRODUCTS = 1 << 16, 1 << 21
#: Products of a block of rows of the sorted strategy, cells and products that it holds at once, cells it hands on at once.
BLOCK_PRODUCTS, BLOCK_CELLS, FORMED, OUT_CELLS = 8_000_000, 1 << 20, 1 << 19, 1 << 18


def _right(b: Matrix) -> DataFrame:
    return b.entries.select(F.col("i").alias("k"), F.col("j").alias("bj"), F.col("v").alias("bv"))


def _check(a: Matrix, b: Matrix) -> None:
    if a.ncols != b.nrows:
        raise ValueError(f"{a.nrows} x {a.ncols} times {b.nrows} x {b.ncols}")


def products(a: Matrix, b: Matrix, heavy: int | None = None) -> DataFrame:
    """(i, j, p) of every product a[i, k] b[k, j]. Keys k of over `heavy` products are dealt to several tasks by i."""
    _check(a, b)
    joined = heavy_join(a.entries.withColumnRenamed("j", "k"), _right(b), ["k"], ["i"], heavy)
    return joined.select("i", F.col("bj").alias("j"), (F.col("v") * F.col("bv")).alias("p"))


def spgemm(a: Matrix, b: Matrix, strategy: str = "hash", drop_zeros: bool = False, members: DataFrame | None = None) -> Matrix:
    """C = A B. hash, sorted and spa keep cancelled cells as zeros unless drop_zeros; cluster and mixed drop them always,
    as zeros are what pads a cluster's lanes.

    hash: join and hash aggregation. sorted: blocks of rows in order, each product summed where it is formed. spa: dense numpy accumulators of blocks of rows.
    cluster: blocks of clusters in cluster layout, lanes are summed together. mixed: clusters are told apart by `work.classify`, dense
    ones get a dense accumulator over their column range, the others the cluster strategy. members(i, cluster, lane, csz).
    """
    if strategy == "sorted":
        out = _sorted(a, b)
    elif strategy in ("hash", "auto"):
        out = products(a, b).groupBy("i", "j").agg(F.sum("p").alias("v"))
    elif strategy == "spa":
        out = _spa(a, b)
    elif strategy == "cluster":
        out = _clustered(a, b, members)
    elif strategy == "mixed":
        out = _mixed(a, b, members)
    else:
        raise ValueError(strategy)
    out = out.filter("v <> 0") if drop_zeros else out
    return Matrix(out, a.nrows, b.ncols)


class _Block:
    """A block's entries of A, row by row, and the rows of B that they meet."""

    def __init__(self, held: Kinds):
        self.rows = [b for b in held.of(0)]
        self.ids, self.size, self.k, self.av = gather(self.rows)
        self.own, size, self.bj, self.bv = gather(held.of(1))
        if len(self.own):
            place = np.minimum(np.searchsorted(self.own, self.k), len(self.own) - 1)
            self.count, self.first = np.where(self.own[place] == self.k, size[place], 0), (np.cumsum(size) - size)[place]

    def sums(self, entries: np.ndarray, row: np.ndarray, column: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells with products, ascending, their sums): entry k of `entries` times its row of B is added to the cells row[k] + column."""
        count, first, av = self.count[entries], self.first[entries], self.av[entries]
        done = np.append(0, np.cumsum(count))
        acc, hit, a = np.zeros(cells), np.zeros(cells, bool), 0
        while a < len(entries):
            z = max(a + 1, min(len(entries), np.searchsorted(done, done[a] + FORMED, side="right") - 1))
            c = count[a:z]
            from_b = np.arange(c.sum()) + np.repeat(first[a:z] - (np.cumsum(c) - c), c)
            cell = np.repeat(row[a:z], c) + column[from_b]
            value = np.repeat(av[a:z], c) * self.bv[from_b]
            if len(cell) * 8 > cells:
                acc += np.bincount(cell, value, cells)
            else:
                np.add.at(acc, cell, value)
            hit[cell] = True
            a = z
        found = np.flatnonzero(hit)
        return found, acc[found]


def _out(i: np.ndarray, j: np.ndarray, v: np.ndarray):
    for x in range(0, len(i), OUT_CELLS):
        y = slice(x, x + OUT_CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(i[y]), pa.array(j[y]), pa.array(v[y])], names=["i", "j", "v"])


def _multiply(batches):
    """(i, j, v), in order, of blocks of rows: batches(part, kind, id, cols, vals) with rows of A, then the rows of B they meet,
    both by id. A block's cells are its rows by the columns that occur in it, BLOCK_CELLS of them at a time."""
    for _, held in by_kind(batches):
        block = _Block(held)
        if not len(block.own):
            continue
        cols, at = np.unique(block.bj, return_inverse=True)
        width, ids = len(cols), block.ids
        row, edge = np.repeat(np.arange(len(ids)), block.size), np.append(0, np.cumsum(block.size))
        most = max(1, BLOCK_CELLS // width)
        for r in range(0, len(ids), most):
            end = min(r + most, len(ids))
            entries = np.arange(edge[r], edge[end])
            found, sums = block.sums(entries, (row[entries] - r) * width, at, (end - r) * width)
            yield from _out(ids[found // width + r], cols[found % width], sums)


def _multiply_clusters(batches):
    """(i, j, v) of blocks of clusters: batches(part, kind, cluster, id, low, width, cols, vals) with rows of A by cluster, then
    the rows of B they meet by id.

    A block's entries are laid out by cluster and shared column, lanes together. A cluster with a width is summed in a
    dense block of its rows by its columns from `low` on, the others by the columns that occur in the block.
    """
    for _, held in by_kind(batches):
        block = _Block(held)
        if not len(block.own):
            continue
        cluster, low, span = (np.concatenate([b.column(c).to_numpy() for b in block.rows]) for c in ("cluster", "low", "width"))
        cols, at = np.unique(block.bj, return_inverse=True)
        width, ids = len(cols), block.ids
        row = np.repeat(np.arange(len(ids)), block.size)
        edge = np.append(0, np.cumsum(block.size))
        laid = lambda a, z: edge[a] + np.lexsort((row[edge[a] : edge[z]], block.k[edge[a] : edge[z]], cluster[row[edge[a] : edge[z]]]))
        cuts = np.append(np.flatnonzero(np.diff(cluster, prepend=cluster[:1] - 1)), len(cluster))
        most, a = max(1, BLOCK_CELLS // width), 0
        while a < len(ids):
            if span[a]:
                end = int(cuts[np.searchsorted(cuts, a, side="right")])
                wide, column, names = int(span[a]), block.bj - low[a], lambda x, lo=low[a]: x + lo
            else:
                dense = np.flatnonzero(span[a : a + most])
                end = a + (int(dense[0]) if len(dense) else min(most, len(ids) - a))
                wide, column, names = width, at, cols.__getitem__
            entries = laid(a, end)
            found, sums = block.sums(entries, (row[entries] - a) * wide, column, (end - a) * wide)
            yield from _out(ids[found // wide + a], names(found % wide), sums)
            a = end


def _operands(a: Matrix, b: Matrix) -> tuple[DataFrame, DataFrame]:
    """Entries (i, k, v) of A and rows (k, n, cols, vals) of B, written once."""
    left = materialize(a.entries.select("i", F.col("j").alias("k"), F.col("v").cast("double").alias("v")), "spgemm-left", "zstd")
    pair = F.collect_list(F.struct("bj", "bv")).alias("row")
    right = _right(b).groupBy("k", "bj").agg(F.sum(F.col("bv").cast("double")).alias("bv")).groupBy("k").agg(pair)
    return left, materialize(right.select("k", F.size("row").cast("long").alias("n"), F.col("row.bj").alias("cols"), F.col("row.bv").alias("vals")), "spgemm-right", "zstd")


def _sorted(a: Matrix, b: Matrix) -> DataFrame:
    """Rows of A are cut into blocks of about BLOCK_PRODUCTS products; a block gets each row of B that it meets once, so rows
    are shuffled and no products. Rows of more products than that go by hash aggregation. Blocks are dealt in order."""
    _check(a, b)
    left, right = _operands(a, b)
    load = left.join(right.select("k", "n"), "k").groupBy("i").agg(F.sum("n").alias("work"))
    cut = materialize(prefix_sum(load, "i", "work").select("i", "work", F.floor(F.col("before") / BLOCK_PRODUCTS).alias("part")), "spgemm-blocks")
    blocks, most = cut.agg(F.coalesce(F.max("part") + 1, F.lit(1)), F.coalesce(F.max("work"), F.lit(0))).first()
    own = left.join(cut.filter(F.col("work") <= BLOCK_PRODUCTS).select("i", "part"), "i")
    pair = F.collect_list(F.struct("k", "v")).alias("row")
    rows = own.groupBy("part", "i").agg(pair).select("part", F.lit(0).alias("kind"), F.col("i").alias("id"), F.col("row.k").alias("cols"), F.col("row.v").alias("vals"))
    met = own.select("part", "k").distinct().join(right, "k").select("part", F.lit(1).alias("kind"), F.col("k").alias("id"), "cols", "vals")
    out = deal(rows.unionByName(met), blocks, "id").mapInArrow(tidy(_multiply), "i long, j long, v double")
    if most <= BLOCK_PRODUCTS:
        return out
    large = Matrix(left.join(cut.filter(F.col("work") > BLOCK_PRODUCTS).select("i"), "i").select("i", F.col("k").alias("j"), "v"), a.nrows, a.ncols)
    rest = products(large, b).groupBy("i", "j").agg(F.sum("p").alias("v"))
    return Matrix(out.unionByName(rest), a.nrows, b.ncols).sorted()


class _Accumulator:
    """A dense block of cells with the list of those that were hit."""

    def __init__(self):
        self.cells, self.hit = np.zeros(0), np.zeros(0, bool)

    def open(self, cluster: int, low: int, width: int, lanes: int) -> None:
        self.cluster, self.low, self.width, self.ids = cluster, low, width, np.full(lanes, -1, np.int64)
        if len(self.cells) < lanes * width:
            self.cells, self.hit = np.zeros(lanes * width), np.zeros(lanes * width, bool)
        self.size = lanes * width

    def add(self, cell: np.ndarray, value: np.ndarray) -> None:
        if len(cell) * 8 > self.size:
            self.cells[: self.size] += np.bincount(cell, value, self.size)
        else:
            np.add.at(self.cells, cell, value)
        self.hit[cell] = True

    def close(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.hit[: self.size])
        out = pa.RecordBatch.from_arrays([pa.array(self.ids[at // self.width]), pa.array(at % self.width + self.low), pa.array(self.cells[at])], names=["i", "j", "v"])
        self.cells[at], self.hit[at] = 0, False
        return out


def _accumulate(batches):
    """Sums of products of batches(cluster, csz, low, width, lane, i, v, bj, bv) that are sorted by cluster.

    A row is the outer product of a column of A inside its cluster and a piece of a row of B. Products are formed
    FLUSH_PRODUCTS at a time and added to one dense block, which is written out where the cluster ends.
    """
    acc, open_ = _Accumulator(), False
    for batch in batches:
        cluster, csz, low, width = (batch.column(k).to_numpy() for k in range(4))
        lane, ids, v, bj, bv = (batch.column(k).flatten().to_numpy() for k in range(4, 9))
        lanes, cols = (np.diff(batch.column(k).offsets.to_numpy()).astype(np.int64) for k in (4, 7))
        lane_at, col_at = np.append(0, np.cumsum(lanes)), np.append(0, np.cumsum(cols))
        done = np.append(0, np.cumsum(lanes * cols))
        ends = np.append(np.flatnonzero(np.diff(cluster)) + 1, len(cluster))
        a = 0
        for end in ends.tolist() if len(cluster) else ():
            if open_ and acc.cluster != cluster[a]:
                yield acc.close()
                open_ = False
            if not open_:
                acc.open(int(cluster[a]), int(low[a]), int(width[a]), int(csz[a]))
                open_ = True
            while a < end:
                z = max(a + 1, min(end, int(np.searchsorted(done, done[a] + FLUSH_PRODUCTS, side="right")) - 1))
                rows = np.repeat(np.arange(a, z), lanes[a:z])  # a row of the batch for each of its lanes
                own = slice(lane_at[a], lane_at[z])
                acc.ids[lane[own]] = ids[own]
                n = cols[rows]
                begin = np.append(0, np.cumsum(n))
                at = np.arange(begin[-1]) + np.repeat(col_at[rows] - begin[:-1], n)
                acc.add(np.repeat(lane[own].astype(np.int64) * acc.width - acc.low, n) + bj[at], np.repeat(v[own], n) * bv[at])
                a = z
    if open_:
        yield acc.close()


def _dense(own: DataFrame, b: Matrix) -> DataFrame:
    """(i, j, v) of the products of own(i, cluster, lane, csz, low, width, k, v) and B in dense accumulators.

    Nothing is summed before them. A column of A inside a cluster and a piece of a row of B, each as arrays, make one
    row, so a shared row of B moves once for all lanes of the cluster. Clusters over HEAVY_ROWS products are dealt to
    several accumulators by k, whose blocks are then added.
    """
    left = own.repartition("cluster", "k").groupBy("cluster", "k", "lane").agg(*[F.any_value(c).alias(c) for c in ("csz", "low", "width", "i")], F.sum("v").alias("v"))
    left = left.groupBy("cluster", "k").agg(*[F.any_value(c).alias(c) for c in ("csz", "low", "width")], F.collect_list(F.struct("lane", "i", "v")).alias("own"))
    right = _right(b).withColumn("piece", F.floor(F.col("bj") / PIECE_COLUMNS)).repartition("k", "piece")
    right = right.groupBy("k", "piece", "bj").agg(F.sum("bv").alias("bv")).groupBy("k", "piece").agg(F.collect_list(F.struct("bj", "bv")).alias("row"))
    joined = left.join(right, "k").select("cluster", "csz", "low", "width", "k", F.size("own").cast("long").alias("n"), *[F.col(f"own.{c}").alias(c) for c in ("lane", "i", "v")], F.col("row.bj").alias("bj"), F.col("row.bv").alias("bv"))
    joined = materialize(joined, "spgemm-rows")
    heavy = joined.groupBy("cluster").agg(F.sum(F.col("n") * F.size("bj")).alias("work")).filter(F.col("work") > HEAVY_ROWS).select("cluster", F.ceil(F.col("work") / HEAVY_ROWS).cast("int").alias("parts"))
    hot = bool(heavy.limit(1).count())
    salt = F.lit(0)
    if hot:
        joined = joined.join(small(heavy), "cluster", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"), F.lit(0))
    dealt = joined.withColumn("salt", salt).repartition(partitions(b.entries.sparkSession), "cluster", "salt").sortWithinPartitions("salt", "cluster")
    out = dealt.select("cluster", "csz", "low", "width", "lane", "i", "v", "bj", "bv").mapInArrow(_accumulate, "i long, j long, v double")
    return out.groupBy("i", "j").agg(F.sum("v").alias("v")) if hot else out


def _spa(a: Matrix, b: Matrix) -> DataFrame:
    """Blocks of rows accumulate into dense rows of B's width; where B is wider than SPA_COLUMNS, the hash strategy."""
    _check(a, b)
    if b.ncols > SPA_COLUMNS:
        return products(a, b).groupBy("i", "j").agg(F.sum("p").alias("v"))
    rows = max(1, min(SPA_ROWS, SPA_CELLS // max(b.ncols, 1)))
    own = a.entries.select("i", F.floor(F.col("i") / rows).alias("cluster"), (F.col("i") % rows).cast("int").alias("lane"), F.lit(rows).alias("csz"), F.lit(0).cast("long").alias("low"), F.lit(b.ncols).cast("long").alias("width"), F.col("j").alias("k"), "v")
    return _dense(own, b)


def _clustered(a: Matrix, b: Matrix, members: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """Clusters are cut into blocks of about BLOCK_PRODUCTS products, and rows of A and of B are shuffled to them, no products.
    Rows of clusters of more products than that go in blocks of rows. dense(cluster, low, width): clusters that are summed
    in a dense block."""
    _check(a, b)
    left, right = _operands(a.compact(), b)
    load = left.join(right.select("k", "n"), "k").groupBy("i").agg(F.sum("n").alias("work")).join(members, "i")
    cut = materialize(work.cluster_blocks(load, BLOCK_PRODUCTS), "spgemm-blocks")
    blocks, most = cut.agg(F.coalesce(F.max("part") + 1, F.lit(1)), F.coalesce(F.max("work"), F.lit(0))).first()
    about = cut.withColumns({"low": F.lit(0).cast("long"), "width": F.lit(0).cast("long")}) if dense is None else cut.join(dense, "cluster", "left").na.fill(0, ["low", "width"])
    place = members.select("i", "cluster").join(about.filter(F.col("work") <= BLOCK_PRODUCTS), "cluster").select("i", "cluster", "part", "low", "width")
    own = left.join(small(place), "i")
    pair = F.collect_list(F.struct("k", "v")).alias("row")
    rows = own.groupBy("part", "cluster", "i", "low", "width").agg(pair).select("part", F.lit(0).alias("kind"), "cluster", F.col("i").alias("id"), "low", "width", F.col("row.k").alias("cols"), F.col("row.v").alias("vals"))
    none = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ("cluster", "low", "width")]
    met = own.select("part", "k").distinct().join(right, "k").select("part", F.lit(1).alias("kind"), F.col("k").alias("id"), "cols", "vals", *none)
    out = deal(rows.unionByName(met), blocks, "cluster", "id").mapInArrow(tidy(_multiply_clusters), "i long, j long, v double")
    if most > BLOCK_PRODUCTS:
        wide = members.join(cut.filter(F.col("work") > BLOCK_PRODUCTS), "cluster").select("i")
        out = out.unionByName(_sorted(a.with_entries(left.join(wide, "i").select("i", F.col("k").alias("j"), "v")), b))
    return out.filter("v <> 0")


def _mixed(a: Matrix, b: Matrix, members: DataFrame) -> DataFrame:
    """Dense clusters accumulate into blocks over their column range, the others take the cluster strategy."""
    flags = materialize(work.classify(a, b, members), "mixed-clusters")  # the symbolic product runs once
    dense = flags.filter("dense = 1").select("cluster", F.col("min_col").alias("low"), (F.col("max_col") - F.col("min_col") + 1).alias("width"))
    return _clustered(a, b, members, dense)


def flops(a: Matrix, b: Matrix) -> DataFrame:
    """(flops): two for each product."""
    nb = b.entries.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("nb"))
    na = a.entries.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("na"))
    return na.join(nb, "k").agg((F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)) * 2).alias("flops"))


def symbolic(a: Matrix, b: Matrix) -> DataFrame:
    """(i, nnz) of C's rows with entries, without values."""
    pairs = heavy_join(a.entries.select("i", F.col("j").alias("k")), b.entries.select(F.col("i").alias("k"), "j"), ["k"], ["i"]).select("i", "j").distinct()
    return pairs.groupBy("i").agg(F.count("*").alias("nnz"))


def topk_jaccard(m: Matrix, k: int = 7) -> DataFrame:
    """(i, j, jaccard): each row's k most similar other rows by shared columns; score falls, ties by j."""
    cells = m.entries.select("i", "j").distinct()
    size = cells.groupBy("i").agg(F.count("*").alias("n"))
    shared = heavy_join(cells, cells.select(F.col("i").alias("o"), "j"), ["j"], ["i"]).filter("i <> o").groupBy("i", "o").agg(F.count("*").alias("c"))
    other = size.select(F.col("i").alias("o"), F.col("n").alias("no"))
    scored = shared.join(size, "i").join(other, "o").select("i", F.col("o").alias("j"), (F.col("c") / (F.col("n") + F.col("no") - F.col("c"))).alias("jaccard"))
    by = Window.partitionBy("i").orderBy(F.desc("jaccard"), "j")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("i", "j", "jaccard")
