"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwell.operators.joins import heavy_join
from gridwell.plans.runtime import shared_dir

#: Links of one node from which they are dealt to several tasks.
HUB_ROWS = 1_000_000


def _round(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """One star round. edges(u, v): every link once, u > v. Where no hubs can be, nodes are not counted for them."""

    def told(rows: DataFrame, low: DataFrame) -> DataFrame:
        return heavy_join(rows, low, ["u"], ["v"], HUB_ROWS) if hubs else rows.join(low, "u")

    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = told(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = told(edges, low).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node reachable.

    Nodes are longs. Links with a null end are ignored, a link to itself keeps its node as a component of one.
    Each round is two shuffles over the links; what it returns is checkpointed in the shared folder, so that a lost
    executor costs one round at most. Nothing but a count and a checksum reaches the driver.
    """
    spark = links.sparkSession
    shared_dir(spark)
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    alone = links.select(F.explode(F.array(a, b)).alias("node")).distinct()
    seen, hubs = None, edges.count() > HUB_ROWS
    for _ in range(max_rounds):
        edges = _round(_round(edges, True, hubs), False, hubs).checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return alone.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
