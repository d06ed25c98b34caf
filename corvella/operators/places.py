"""Places in an order, sums along it and roots of links, for keys and chains of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.operators.cut import stored

_LOCAL = (1 << 33) - 1

#: Rows that a running sum takes at once.
RUN = 4096


def in_order(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """rows with rank (from 0, within key, by order) and n (rows of the key), written.

    One range exchange; a key that fills a third of the table is cut like any other.
    """
    by = [*key, *order]
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("__serial", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__serial", 33)).withColumn("__local", F.col("__serial").bitwiseAND(_LOCAL))
    runs = ranged.groupBy("__part", *key).agg(F.min("__local").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*key)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {k: f"__k{i}" for i, k in enumerate(key)}
    runs = runs.select(F.col("__part").alias("__p"), *[F.col(k).alias(v) for k, v in names.items()], (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    same = F.col("__part") == F.col("__p")
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    return stored(ranged.join(runs, same).select(*rows.columns, (F.col("__shift") + F.col("__local")).alias("rank"), "n"))


def summed(ranked: DataFrame, key: list[str], amount: str) -> DataFrame:
    """ranked(key, rank, amount) with sum: of amount over the key's rows up to and with each.

    A key's rows are summed in runs of 4096 by rank, then its runs; neither is one task's whole work for a long key.
    """
    rows = ranked.withColumn("__run", F.expr(f"rank div {RUN}"))
    own = F.sum(amount).over(W.partitionBy(*key, "__run").orderBy("rank"))
    runs = rows.groupBy(*key, "__run").agg(F.sum(amount).alias("__all"))
    runs = runs.withColumn("__before", F.coalesce(F.sum("__all").over(W.partitionBy(*key).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    return rows.withColumn("sum", own).join(runs, [*key, "__run"]).withColumn("sum", F.col("sum") + F.col("__before")).drop("__run", "__before")


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of links(node, to): where following the links ends. Roots link to themselves; rounds are the logarithm of the longest way."""
    at = stored(links.select("node", "to"))
    while True:
        following = at.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = stored(at.join(following, "to").select("node", "to", "next"))
        moved = step.filter("to <> next").limit(1).count()
        at = step.select("node", F.col("next").alias("to"))
        if not moved:
            return at.withColumnRenamed("to", "root")
