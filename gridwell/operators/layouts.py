"""Storage layouts as views of the entries, and their inverses.

Matrices are compacted first wherever a layout holds one value a cell, so that all layouts stand for the same matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridwell.operators.matrix import Matrix, prefix_sum, prefix_sums, rank_by_count
from gridwell.plans.runtime import small


def csr_row_offsets(m: Matrix) -> DataFrame:
    """(i, start): entries before row i, for every row."""
    return prefix_sum(m.row_counts(), "i", "n", "start").select("i", "start")


def csr_rows(m: Matrix) -> DataFrame:
    """(i, cols, vals) of rows with entries, columns ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("j", "v")))
    return m.entries.groupBy("i").agg(pairs.alias("p")).select("i", F.col("p.j").alias("cols"), F.col("p.v").alias("vals"))


def csr_to_entries(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))


def ell(m: Matrix) -> DataFrame:
    """(i, slot, j, v): every row padded to the widest with column -1 and value 0.

    A row is padded as an array and unfolded last: a frame of all slots would be taken for as small as its rows, and be
    broadcast.
    """
    held = m.compact().entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("own"))
    width = m.compact().entries.groupBy("i").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if width == 0:
        return m.entries.limit(0).select("i", F.lit(0).alias("slot"), "j", "v")
    pad = F.struct(F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("v"))
    own = F.coalesce("own", F.array().cast(held.schema["own"].dataType))
    every = m.rows().join(held, "i", "left").select("i", F.concat(own, F.array_repeat(pad, F.lit(width).cast("int") - F.size(own))).alias("own"))
    return every.select("i", F.posexplode("own").alias("slot", "e")).select("i", "slot", F.col("e.j").alias("j"), F.col("e.v").alias("v"))


def sell_widths(counts: DataFrame, chunk: int, align: int) -> DataFrame:
    """(chunk, width) of counts(new_row, n): the widest row of each chunk, rounded up to the alignment."""
    widest = counts.groupBy(F.floor(F.col("new_row") / chunk).alias("chunk")).agg(F.max("n").alias("n"))
    return widest.select("chunk", (F.ceil(F.col("n") / align) * align).alias("width"))


def sell_order(m: Matrix, sigma: int | None, chunk: int) -> DataFrame:
    """(i, n, new_row): sigma 0 keeps the order, None sorts all rows, else slices of sigma rows are sorted."""
    counts = m.compact().row_counts()
    if sigma == 0:
        return counts.withColumn("new_row", F.col("i"))
    if sigma is not None and sigma % chunk:
        raise ValueError("sigma is not a multiple of the chunk")
    return rank_by_count(counts, sigma)


def sell(m: Matrix, sigma: int | None, chunk: int, align: int) -> DataFrame:
    """(chunk, new_row, i, slot, j, v) of a sliced ELL layout without its padding; width is the chunk's."""
    order = sell_order(m, sigma, chunk)
    slots = m.compact().entries.withColumn("slot", F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1)
    return slots.join(order.select("i", "new_row"), "i").withColumn("chunk", F.floor(F.col("new_row") / chunk)).select("chunk", "new_row", "i", "slot", "j", "v")


def dia(m: Matrix, max_diags: int = 10240) -> DataFrame:
    """(offset, n, first_i, vals): entries of each diagonal as a map of row to value."""
    own = m.compact().entries.withColumn("offset", F.col("j") - F.col("i"))
    if own.select("offset").distinct().limit(max_diags + 1).count() > max_diags:
        raise ValueError(f"more than {max_diags} diagonals")
    return own.groupBy("offset").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "v")))).alias("vals"))


def dia_numbers(diagonals: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(offset, number): diagonals in the order in which a scan by rows first meets them, for nrows * (nrows + ncols) < 2^63."""
    key = F.col("first_i") * (nrows + ncols) + F.col("offset") + nrows
    return prefix_sums(diagonals.select("offset", key.alias("key")), "key", {"number": F.lit(1)}).select("offset", "number")


def bsr(m: Matrix, br: int, bc: int) -> DataFrame:
    """(bi, bj, n, block): dense row-major blocks of br x bc values."""
    own = m.compact().entries.select(F.floor(F.col("i") / br).alias("bi"), F.floor(F.col("j") / bc).alias("bj"), ((F.col("i") % br) * bc + F.col("j") % bc).cast("int").alias("at"), "v")
    held = own.groupBy("bi", "bj").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("cells"))
    block = F.transform(F.sequence(F.lit(0), F.lit(br * bc - 1)), lambda p: F.coalesce(F.try_element_at("cells", p), F.lit(0.0)))
    return held.select("bi", "bj", "n", block.alias("block"))


def bsr_row_ptr(m: Matrix, br: int, bc: int) -> DataFrame:
    """(bi, start): blocks before block row bi."""
    own = m.entries.select(F.floor(F.col("i") / br).alias("bi"), F.floor(F.col("j") / bc).alias("bj")).distinct().groupBy("bi").agg(F.count("*").alias("n"))
    every = m.entries.sparkSession.range(-(-m.nrows // br)).withColumnRenamed("id", "bi").join(own, "bi", "left").select("bi", F.coalesce("n", F.lit(0)).alias("n"))
    return prefix_sum(every, "bi", "n", "start").select("bi", "start")


def csr5(m: Matrix, omega: int, sigma: int) -> DataFrame:
    """(tile, lane, pos, i, j, v): row-major entries cut into tiles of omega lanes of sigma entries."""
    own = m.compact()
    starts = csr_row_offsets(own)
    slots = own.entries.withColumn("slot", F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1)
    at = slots.join(starts, "i").withColumn("at", F.col("start") + F.col("slot"))
    size = omega * sigma
    return at.select(F.floor(F.col("at") / size).alias("tile"), F.floor(F.col("at") % size / sigma).alias("lane"), (F.col("at") % sigma).alias("pos"), "i", "j", "v")


def csr5_tiles(m: Matrix, omega: int, sigma: int) -> DataFrame:
    """(tile, tile_ptr, last_row, n, has_empty): first row of each tile, and whether its row span has empty rows."""
    tiles = csr5(m, omega, sigma).groupBy("tile").agg(F.min("i").alias("tile_ptr"), F.max("i").alias("last_row"), F.count("*").alias("n"), F.count_distinct("i").alias("rows"))
    return tiles.select("tile", "tile_ptr", "last_row", "n", (F.col("rows") < F.col("last_row") - F.col("tile_ptr") + 1).alias("has_empty"))


def csr5_marked(tiles: DataFrame) -> DataFrame:
    """csr5_tiles with dirty: whether rows are empty from the tile's first row up to the next tile's. The last tile, which
    has no next, is never dirty."""
    after = tiles.select((F.col("tile") - 1).alias("tile"), F.col("tile_ptr").alias("next_ptr"))
    gap = F.col("has_empty") | (F.col("next_ptr") > F.col("last_row") + 1)
    return tiles.join(after, "tile", "left").select(*tiles.columns, F.coalesce(gap, F.lit(False)).alias("dirty"))


def csr5_lanes(m: Matrix, omega: int, sigma: int) -> DataFrame:
    """(tile, lane, flags, y_offset): a string with 1 where a row's first entry stands, position by position, and how many
    such entries the tile's earlier lanes hold."""
    own = csr5(m, omega, sigma).withColumn("head", F.row_number().over(Window.partitionBy("i").orderBy("j")) == 1)
    held = own.groupBy("tile", "lane").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("head"), "1").otherwise("0").alias("f")))).alias("p"), F.count_if("head").alias("heads"))
    before = F.sum("heads").over(Window.partitionBy("tile").orderBy("lane")) - F.col("heads")
    return held.select("tile", "lane", F.array_join(F.col("p.f"), "").alias("flags"), before.alias("y_offset"))


def fixed_clusters(m: Matrix, size: int) -> DataFrame:
    """(i, cluster, lane, csz) of every row, `size` consecutive rows a cluster."""
    return m.rows().select("i", F.floor(F.col("i") / size).alias("cluster"), (F.col("i") % size).cast("int").alias("lane"), F.lit(size).alias("csz"))


def variable_clusters(m: Matrix, offsets: DataFrame) -> DataFrame:
    """(i, cluster, lane, csz) of every row; offsets(cluster, start, stop) from 0 to all rows without gaps."""
    ends = offsets.agg(F.min("start"), F.max("stop"), F.sum(F.col("stop") - F.col("start")), F.min(F.col("stop") - F.col("start"))).first()
    if ends[0] != 0 or ends[1] != m.nrows or ends[2] != m.nrows or ends[3] < 1:
        raise ValueError("offsets start at 0, end at all rows and leave no gap")
    return offsets.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"), "cluster", "start", (F.col("stop") - F.col("start")).cast("int").alias("csz")).select("i", "cluster", (F.col("i") - F.col("start")).cast("int").alias("lane"), "csz")


def cluster_layout(m: Matrix, members: DataFrame) -> DataFrame:
    """(cluster, csz, j, lanes): the rows of a cluster share columns, with one value a lane and 0 where absent."""
    own = m.compact().entries.join(members, "i")
    held = own.groupBy("cluster", "csz", "j").agg(F.map_from_entries(F.collect_list(F.struct("lane", "v"))).alias("cells"))
    lanes = F.transform(F.sequence(F.lit(0), F.col("csz") - 1), lambda p: F.coalesce(F.try_element_at("cells", p), F.lit(0.0)))
    return held.select("cluster", "csz", "j", lanes.alias("lanes"))


def cluster_to_entries(layout: DataFrame, members: DataFrame, eps: float = 0.0) -> DataFrame:
    """Entries of a cluster layout; values of magnitude eps or less (eps 0: zeros) go."""
    spread = layout.select("cluster", "j", F.posexplode("lanes").alias("lane", "v")).filter((F.abs("v") > eps) if eps == 0 else (F.abs("v") >= eps))
    return spread.join(small(members.select("cluster", "lane", "i")), ["cluster", "lane"]).select("i", "j", "v")
