"""Places of rows in an order, and what lies before them, without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.store import Cuts, few, shuffle_width

_LOCAL = (1 << 33) - 1


def in_order(rows: DataFrame, cuts: Cuts, key: list[str], order: list[str | Column], amount: str | None = None) -> DataFrame:
    """rows with rank (from 0, within key, by order), n (rows of the key) and, with amount, before and total (its sum over earlier rows and over the key).

    Rows that are equal in key and order are taken in the order of the input, so that a key or
    a row that fills a third of the table is cut like any other: one range exchange of the
    rows, one row for each run of a key in a partition, and, with amount, one more exchange
    for the sums within runs. Null keys are a key of their own. The result is written.
    """
    placed = cuts.cut(rows.withColumn("__at", F.monotonically_increasing_id()), "placed")
    by = [*key, *order, "__at"]
    ranged = placed.repartitionByRange(shuffle_width(rows.sparkSession), *by).sortWithinPartitions(*by).drop("__at")
    written = cuts.cut(ranged.withColumn("__serial", F.monotonically_increasing_id()), "ranged")
    cuts.drop(placed)
    ranged = written.withColumn("__part", F.shiftright("__serial", 33)).withColumn("__local", F.col("__serial").bitwiseAND(_LOCAL))
    sums = [F.sum(amount).alias("__sum")] if amount else []
    runs = ranged.groupBy("__part", *key).agg(F.min("__local").alias("__first"), F.count(F.lit(1)).alias("__n"), *sums)
    whole = W.partitionBy(*key)
    earlier = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    known = [(F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n")]
    if amount:
        known += [F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"), F.sum("__sum").over(whole).alias("total")]
    names = {k: f"__k{i}" for i, k in enumerate(key)}
    # One row for each run: partitions and keys together.
    runs = cuts.cut(runs.select(F.col("__part").alias("__p"), *[F.col(k).alias(v) for k, v in names.items()], *known), "runs")
    if amount:
        own = W.partitionBy("__part", *key).orderBy("__serial")
        ranged = ranged.withColumn("__own", F.sum(amount).over(own) - F.col(amount))
    same = F.col("__part") == F.col("__p")
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    found = [(F.col("__shift") + F.col("__local")).alias("rank"), "n"]
    if amount:
        found += [(F.col("__before") + F.col("__own")).alias("before"), "total"]
    out = cuts.cut(ranged.join(few(runs), same).select(*rows.columns, *found), "ordered")
    cuts.drop(written, runs)
    return out
