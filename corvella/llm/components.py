"""Connected components of a graph held in tables, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.store import Cuts


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges(u, v), both long and not null.

    Large-star and small-star rounds (Kiveris et al., 2014): each round links the larger
    neighbours of a node, then the smaller ones, to the smallest, until nothing changes. The
    number of edges never grows, minima are combined before the exchange, and a hub's edges
    meet its minimum in a plain join, which Spark can split. Each round's table is written to
    the shared folder.
    """
    cuts = Cuts(edges.sparkSession, "components")
    now = cuts.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        tally = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (tally["n"], tally["s"]) == before or not tally["n"]:
            break
        before = (tally["n"], tally["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cuts.cut(large, "large")
        # Edges now point from larger to smaller.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cuts.cut(hung.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        cuts.drop(now, large)
        now = nxt
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
