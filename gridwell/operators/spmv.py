"""y <- alpha A x + beta y in every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwell.operators import layouts
from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import small

LAYOUTS = ("csr", "coo", "bsr", "csr5", "dia", "ell", "sell", "sell_c_sigma", "sell_c_r")


def _sums(m: Matrix, x: DataFrame, layout: str, chunk: int, sigma: int, align: int) -> DataFrame:
    """(i, s) with s the product of row i and x, for rows with entries."""
    x = small(x)
    plain = lambda e: e.join(x, F.col("j") == F.col("idx")).groupBy("i").agg(F.sum(F.col("v") * F.col("val")).alias("s"))
    if layout == "coo":
        return plain(m.entries)
    if layout == "csr":
        return plain(layouts.csr_to_entries(layouts.csr_rows(m)))
    if layout == "ell":
        return plain(layouts.ell(m).filter("j >= 0"))
    if layout in ("sell", "sell_c_sigma", "sell_c_r"):
        return plain(layouts.sell(m, {"sell": 0, "sell_c_sigma": sigma, "sell_c_r": None}[layout], chunk, align))
    if layout == "dia":
        spread = layouts.dia(m, max(10240, m.nrows + m.ncols)).select("offset", F.explode("vals").alias("i", "v"))
        return plain(spread.select("i", (F.col("i") + F.col("offset")).alias("j"), "v"))
    if layout == "bsr":
        br, bc = chunk, align
        parts = x.groupBy(F.floor(F.col("idx") / bc).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("idx") % bc).cast("int"), "val"))).alias("m"))
        parts = parts.select("bj", F.transform(F.sequence(F.lit(0), F.lit(bc - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("xs"))

        def row(r: Column) -> Column:
            return F.aggregate(F.zip_with(F.slice("block", r * bc + 1, bc), "xs", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)

        dots = layouts.bsr(m, br, bc).join(parts, "bj").select("bi", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(br - 1)), row)).alias("r", "p"))
        return dots.groupBy((F.col("bi") * br + F.col("r")).alias("i")).agg(F.sum("p").alias("s"))
    if layout == "csr5":
        tiles = layouts.csr5(m, align, chunk).join(x, F.col("j") == F.col("idx"))
        segments = tiles.groupBy("tile", "i").agg(F.sum(F.col("v") * F.col("val")).alias("p"))  # in the tile, then over tiles
        return segments.groupBy("i").agg(F.sum("p").alias("s"))
    raise ValueError(f"layout is one of {LAYOUTS}")


def spmv(m: Matrix, x: DataFrame, y: DataFrame, alpha: float = 1.0, beta: float = 0.0, layout: str = "coo", chunk: int = 8, sigma: int = 64, align: int = 4) -> DataFrame:
    """(i, y) for every row, empty ones included. x(idx, val), y(idx, val); beta 0 ignores y.

    x is broadcast if counted and small, else both sides shuffle on the column; sums combine before the shuffle by row.
    """
    sums = _sums(m, x, layout, chunk, sigma, align)
    out = m.rows().join(sums, "i", "left")
    value = F.lit(alpha) * F.coalesce("s", F.lit(0.0))
    if beta:
        out = out.join(y.select(F.col("idx").alias("i"), F.col("val").alias("old")), "i", "left")
        value = value + F.lit(beta) * F.coalesce("old", F.lit(0.0))
    return out.select("i", value.alias("y"))
