"""Structural features of a matrix as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwell.operators.matrix import Matrix

GRID = 256


def basic(m: Matrix) -> DataFrame:
    return m.entries.agg(F.lit(m.nrows).cast("long").alias("nrows"), F.lit(m.ncols).cast("long").alias("ncols"), F.count("*").alias("nnz"), (F.count("*") / (F.lit(float(m.nrows)) * m.ncols)).alias("density"))


def triangles(m: Matrix) -> DataFrame:
    return m.entries.agg(F.count_if(F.col("i") > F.col("j")).alias("lower"), F.count_if(F.col("i") < F.col("j")).alias("upper"), F.count_if(F.col("i") == F.col("j")).alias("diagonal"))


def diagonals(m: Matrix) -> DataFrame:
    """Distinct diagonals, and the share of entries within a twentieth of all of them from the main one."""
    off, near = F.col("j") - F.col("i"), (m.nrows + m.ncols - 1) // 20
    by = m.entries.groupBy(off.alias("o")).agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("diagonals"), (F.coalesce(F.sum(F.when(F.abs("o") <= near, F.col("n"))), F.lit(0)) / F.sum("n")).alias("near_share"))


def spread(counts: DataFrame, shifted: bool = False) -> DataFrame:
    """Non-empty share, min, max, mean, population variance and deviation of counts(n), from integer moments.

    shifted starts the counting of non-empty and squared deviations at -1, as some published figures do.
    """
    s = counts.agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") > 0).alias("full"))
    var = (F.col("c") * F.col("q") - F.col("s") * F.col("s")) / (F.col("c") * F.col("c"))
    full = F.col("full")
    if shifted:
        var, full = var - 1 / F.col("c"), full - 1
    return s.select((full / F.col("c")).alias("nonempty"), "least", "most", (F.col("s") / F.col("c")).alias("mean"), F.round(var, 6).alias("variance"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("deviation"))


def _by_size(counts: DataFrame) -> DataFrame:
    """(n, k) how many have each count: what order statistics need, however many rows there are."""
    return counts.groupBy("n").agg(F.count("*").alias("k"))


def p_ratio(counts: DataFrame) -> DataFrame:
    """(p): the least share p = c / N of the largest counts with p + their part of all entries >= 1.

    Worked out on the histogram of counts: inside a run of equal counts the first c that reaches it is a quotient.
    """
    h = _by_size(counts)
    total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size, nnz = total
    if not nnz:
        return h.select(F.lit(1.0).alias("p")).limit(1)
    by = Window.orderBy(F.desc("n"))
    run = h.withColumn("c0", F.sum("k").over(by) - F.col("k")).withColumn("s0", F.sum(F.col("n") * F.col("k")).over(by) - F.col("n") * F.col("k"))
    # (c0 + x) / size + (s0 + x n) / nnz >= 1, in integers: x (nnz + n size) >= size nnz - c0 nnz - s0 size
    one = 1 if size * nnz < 1 << 62 else 1.0  # doubles where the products leave the range of a long
    need = F.lit(size * nnz * one) - F.col("c0") * nnz * one - F.col("s0") * size * one
    x = F.greatest(F.lit(1), F.ceil(need / (F.lit(nnz) + F.col("n") * size * one)))
    return run.filter(x <= F.col("k")).agg(F.min((F.col("c0") + x) / F.lit(size)).alias("p"))


def gini(counts: DataFrame) -> DataFrame:
    """(gini): area between the even line and the Lorenz curve of ascending counts, by the trapezoidal rule."""
    h = _by_size(counts)
    size, nnz = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not nnz:
        return h.select(F.lit(0.0).alias("gini")).limit(1)
    by = Window.orderBy("n")
    run = h.withColumn("s0", F.sum(F.col("n") * F.col("k")).over(by) - F.col("n") * F.col("k"))
    # k equal counts add k s0 + n k (k + 1) / 2 to the sum of the running sums
    sums = run.agg(F.sum(F.col("k") * F.col("s0") * 2 + F.col("n") * F.col("k") * (F.col("k") + 1)).alias("twice"))
    # B = c1 / 2 + sum of (c_t + c_(t+1)) / 2 = sum of c - c_last / 2
    b = F.col("twice") / 2 - nnz / 2
    return sums.select(F.round((nnz * size / 2 - b) / (nnz * size / 2), 9).alias("gini"))


def symmetry(m: Matrix) -> DataFrame:
    """Shares of off-diagonal entries whose mirror is stored, and whose mirror has the same value at six decimals."""
    if m.nrows != m.ncols:
        return m.entries.sparkSession.range(1).select(F.lit(0.0).alias("pattern"), F.lit(0.0).alias("value"), F.lit(0).alias("is_symmetric"))
    own = m.compact(drop_zeros=False).entries.filter("i <> j")
    mirror = own.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    hit = own.join(mirror, ["i", "j"], "left")
    out = hit.agg((F.count("w") / F.count("*")).alias("pattern"), (F.count_if(F.round("v", 6) == F.round("w", 6)) / F.count("*")).alias("value"))
    out = out.select(F.coalesce("pattern", F.lit(1.0)).alias("pattern"), F.coalesce("value", F.lit(1.0)).alias("value"))
    return out.withColumn("is_symmetric", ((F.col("pattern") == 1) & (F.col("value") == 1)).cast("int"))


def diagonal_dominance(m: Matrix) -> DataFrame:
    own = m.entries.groupBy("i").agg((F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.abs("v"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(F.col("i") != F.col("j"), F.abs("v"))), F.lit(0.0))).alias("d"))
    return own.agg((F.count_if(F.col("d") > 0) / F.lit(min(m.nrows, m.ncols))).alias("dominance"))


def max_values(m: Matrix) -> DataFrame:
    return m.entries.agg(F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.abs("v"))), F.lit(0.0)).alias("on_diagonal"), F.coalesce(F.max(F.when(F.col("i") != F.col("j"), F.abs("v"))), F.lit(0.0)).alias("off_diagonal"))


def variability(m: Matrix, key: str) -> DataFrame:
    """Largest spread of log10 |v| in a row (key i) or column (key j); the top is 0 at least, the bottom 0 at most, and
    lines whose bottom is 0 do not count. -1 without any."""
    log = F.when(F.col("v") != 0, F.log10(F.abs("v")))
    own = m.entries.groupBy(key).agg(F.greatest(F.lit(0.0), F.max(log)).alias("top"), F.least(F.lit(0.0), F.min(log)).alias("low"))
    return own.filter("low <> 0").agg(F.coalesce(F.round(F.max(F.col("top") - F.col("low")), 6), F.lit(-1.0)).alias("variability"))


def block_id(at: Column, size: int, grid: int = GRID) -> Column:
    """Block of a row or column: size % grid blocks with one more than size // grid, then the others."""
    small_, more = size // grid, size % grid
    first = more * (small_ + 1)
    return F.when(at < first, F.floor(at / (small_ + 1))).otherwise(more + F.floor((at - first) / max(small_, 1)))


def tile_ids(m: Matrix, grid: int = GRID) -> DataFrame:
    return m.entries.select("i", "j", block_id(F.col("i"), m.nrows, grid).alias("tile_r"), block_id(F.col("j"), m.ncols, grid).alias("tile_c"))


def block_counts(m: Matrix, by: str, grid: int = GRID) -> DataFrame:
    """(id, n) of every tile (by tile), row block (rb) or column block (cb), empty ones included."""
    t = tile_ids(m, grid)
    key = {"tile": F.col("tile_r") * grid + F.col("tile_c"), "rb": F.col("tile_r"), "cb": F.col("tile_c")}[by]
    own = t.groupBy(key.alias("id")).agg(F.count("*").alias("n"))
    return m.entries.sparkSession.range(grid * grid if by == "tile" else grid).join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def inner_counts(m: Matrix, by: str, grid: int = GRID) -> DataFrame:
    """(id, lines, most, mean): entries of a line inside each tile (its rows), row block (rows) or column block (columns)."""
    t = tile_ids(m, grid)
    key = {"tile": F.col("tile_r") * grid + F.col("tile_c"), "rb": F.col("tile_r"), "cb": F.col("tile_c")}[by]
    line = "j" if by == "cb" else "i"
    per = t.groupBy(key.alias("id"), line).agg(F.count("*").alias("n"))
    return per.groupBy("id").agg(F.count("*").alias("lines"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.sqrt((F.count("*") * F.sum(F.col("n") * F.col("n")) - F.sum("n") * F.sum("n")) / (F.count("*") * F.count("*"))), 6).alias("deviation"))


def reuse(m: Matrix, grid: int = GRID) -> DataFrame:
    """Distinct rows and columns summed over tiles, over entries (uniq) and over rows or columns (reuse)."""
    t = tile_ids(m, grid)
    r, c = t.select("i", "tile_c").distinct(), t.select("j", "tile_r").distinct()
    nnz, nr, nc = m.entries.count(), r.count(), c.count()
    return m.entries.sparkSession.range(1).select(F.lit(nr / max(nnz, 1)).alias("uniq_r"), F.lit(nc / max(nnz, 1)).alias("uniq_c"), F.lit(nr / m.nrows).alias("reuse_r"), F.lit(nc / m.ncols).alias("reuse_c"))


def group_reuse(m: Matrix, group: int = 8, grid: int = GRID) -> DataFrame:
    """As reuse, with `group` consecutive rows or columns of a tile counted as one."""
    t = tile_ids(m, grid)
    r = t.select(F.floor(F.col("i") / group).alias("g"), "tile_r", "tile_c").distinct()
    c = t.select(F.floor(F.col("j") / group).alias("g"), "tile_r", "tile_c").distinct()
    nnz, nr, nc = m.entries.count(), r.count(), c.count()
    return m.entries.sparkSession.range(1).select(F.lit(nr / max(nnz, 1)).alias("group_uniq_r"), F.lit(nc / max(nnz, 1)).alias("group_uniq_c"), F.lit(nr / m.nrows).alias("group_reuse_r"), F.lit(nc / m.ncols).alias("group_reuse_c"))


def row_distance(m: Matrix) -> DataFrame:
    """Mean over all rows of the summed gaps between a row's columns over its entries, and that over the columns."""
    own = m.entries.groupBy("i").agg(((F.max("j") - F.min("j")) / F.count("*")).alias("d"))
    total = F.coalesce(F.sum(F.col("d").cast("decimal(38,12)")), F.lit(0)).cast("double") / m.nrows
    return own.agg(F.round(total, 6).alias("distance"), F.round(total / m.ncols, 6).alias("share"))


def max_relative_error(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 2.220446049250313e-16) -> DataFrame:
    """(error): max |x - y| / (|x| + |y| + sqrt(eps)) over cells of either; absent cells are 0."""
    both = a.select(*keys, F.col("v").alias("x")).join(b.select(*keys, F.col("v").alias("y")), keys, "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return both.agg(F.coalesce(F.round(F.max(F.abs(F.col("x") - F.col("y")) / (F.abs("x") + F.abs("y") + eps**0.5)), 9), F.lit(0.0)).alias("error"))


def differing(a: DataFrame, b: DataFrame, keys: list[str], rel: float = 1e-10, absolute: float = 1e-6, ignore: float = 1e-12) -> DataFrame:
    """Cells that differ: neither within the relative nor the absolute tolerance; magnitudes under `ignore` count as 0."""
    value = lambda c: F.when(F.abs(F.coalesce(c, F.lit(0.0))) < ignore, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    both = a.select(*keys, F.col("v").alias("x")).join(b.select(*keys, F.col("v").alias("y")), keys, "full").withColumn("x", value(F.col("x"))).withColumn("y", value(F.col("y")))
    gap = F.abs(F.col("x") - F.col("y"))
    return both.filter((gap > absolute) & (gap > rel * F.greatest(F.abs("x"), F.abs("y"))))


def compare_pairs(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(i, only_a, only_b, different): for each row of two lists (i, j, score), the pairs that one of them lacks and those
    whose scores differ by more than `tolerance`. Rows that agree are not in it."""
    both = a.select("i", "j", F.col("score").alias("x")).join(b.select("i", "j", F.col("score").alias("y")), ["i", "j"], "full")
    told = both.groupBy("i").agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("different"))
    return told.filter("only_a + only_b + different > 0")
