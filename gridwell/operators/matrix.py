"""A sparse matrix is a DataFrame of entries (i, j, v) and its dimensions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwell.plans.runtime import small

#: Keys of a bucket in two-level scans and ranks.
SCAN_BUCKET = 1 << 16


@dataclass(frozen=True)
class Matrix:
    """entries(i long, j long, v double), 0-based; absent cells are zero, duplicate cells stand for their sum.

    The dimensions are kept apart because empty rows and columns do not show in the entries.
    """

    entries: DataFrame
    nrows: int
    ncols: int

    def with_entries(self, entries: DataFrame) -> Matrix:
        return replace(self, entries=entries)

    def rows(self) -> DataFrame:
        """All row ids as (i)."""
        return self.entries.sparkSession.range(self.nrows).withColumnRenamed("id", "i")

    def cols(self) -> DataFrame:
        return self.entries.sparkSession.range(self.ncols).withColumnRenamed("id", "j")

    def row_counts(self) -> DataFrame:
        """(i, n) with stored entries of every row, empty rows included."""
        own = self.entries.groupBy("i").agg(F.count("*").alias("n"))
        return self.rows().join(own, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))

    def col_counts(self) -> DataFrame:
        own = self.entries.groupBy("j").agg(F.count("*").alias("n"))
        return self.cols().join(own, "j", "left").select("j", F.coalesce("n", F.lit(0)).alias("n"))

    def compact(self, drop_zeros: bool = True) -> Matrix:
        """One entry a cell: duplicates are summed, sums of exactly zero go."""
        summed = self.entries.groupBy("i", "j").agg(F.sum("v").alias("v"))
        return self.with_entries(summed.filter("v <> 0") if drop_zeros else summed)

    def transpose(self) -> Matrix:
        flipped = self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return Matrix(flipped, self.ncols, self.nrows).compact()

    def pattern(self) -> Matrix:
        return self.with_entries(self.entries.withColumn("v", F.lit(1.0)))

    def reorder(self, perm: DataFrame) -> Matrix:
        """New row r is old row perm[r]; perm(new_row, old_row). Old rows that are in no pair go."""
        moved = self.entries.join(small(perm), F.col("i") == F.col("old_row")).select(F.col("new_row").alias("i"), "j", "v")
        return replace(self, entries=moved)

    def sorted(self) -> DataFrame:
        """Entries range-partitioned by row and sorted by column in each row."""
        return self.entries.repartitionByRange("i").sortWithinPartitions("i", "j")


def invert(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("old_row").alias("new_row"), F.col("new_row").alias("old_row"))


def rows_sorted_unique(m: Matrix, order: str) -> DataFrame:
    """(i, ok) for rows with entries: whether columns strictly increase in the order of column `order`."""
    by = Window.partitionBy("i").orderBy(order)
    steps = m.entries.withColumn("prev", F.lag("j").over(by))
    return steps.groupBy("i").agg(F.bool_and(F.coalesce(F.col("j") > F.col("prev"), F.lit(True))).alias("ok"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "before") -> DataFrame:
    """Exclusive running sum of `value` in the order of the long `key` (unique), by a two-level scan."""
    return prefix_sums(df, key, {out: F.col(value)})


def prefix_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums of several values (weighted, multiplied) in one two-level scan; sums maps new columns to values.

    Only bucket totals, a row for SCAN_BUCKET keys, pass one task; rows are scanned inside their buckets.
    """
    values = {f"__v{k}": v for k, v in enumerate(sums.values())}
    held = df.withColumns({"__b": F.floor(F.col(key) / SCAN_BUCKET), **values})
    totals = held.groupBy("__b").agg(*[F.sum(v).alias(v) for v in values])
    above, inside = Window.orderBy("__b"), Window.partitionBy("__b").orderBy(key)
    base = totals.select("__b", *[(F.sum(v).over(above) - F.col(v)).alias(f"{v}_base") for v in values])
    scanned = held.withColumns({f"{v}_in": F.sum(v).over(inside) - F.col(v) for v in values}).join(base, "__b")
    return scanned.select(*df.columns, *[(F.col(f"{v}_base") + F.col(f"{v}_in")).alias(out) for out, v in zip(sums, values)])


def rank_by_count(counts: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """(i, n, new_row): rows by (n, i), both descending, inside slices of `slice_rows` rows or over all rows.

    Over all rows the rank is two-level: sizes of (n, bucket of i) groups are scanned, rows are numbered inside them.
    """
    if slice_rows:
        by = Window.partitionBy("slice").orderBy(F.desc("n"), F.desc("i"))
        cut = counts.withColumn("slice", F.floor(F.col("i") / slice_rows))
        return cut.select("i", "n", (F.col("slice") * slice_rows + F.row_number().over(by) - 1).alias("new_row"))
    held = counts.withColumn("b", F.floor(F.col("i") / SCAN_BUCKET))
    groups = held.groupBy("n", "b").agg(F.count("*").alias("size"))
    base = groups.select("n", "b", (F.sum("size").over(Window.orderBy(F.desc("n"), F.desc("b"))) - F.col("size")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("n", "b").orderBy(F.desc("i"))) - 1
    return held.withColumn("r", inner).join(base, ["n", "b"]).select("i", "n", (F.col("base") + F.col("r")).cast("long").alias("new_row"))
