"""Merges of stored tables with new rows, as plans that give the new table; formats without MERGE need no more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows merged by key: new values win, but in keep_old columns a null leaves the old value."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    fresh = F.col(f"b.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key or c in keep_old:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
        return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def sync_rows(incoming: DataFrame, stored: DataFrame, key: str, mode: str) -> DataFrame:
    """The incoming rows that a sync mode takes: all, those not stored, or those stored."""
    if mode in ("import_all", "sync_missing_pdfs"):
        return incoming
    if mode not in ("sync_differences", "refresh_metadata"):
        raise ValueError(f"no such mode: {mode}")
    return incoming.join(stored.select(key), key, "left_anti" if mode == "sync_differences" else "left_semi")


def committee_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each document, name and role (null roles never meet): a row from the API stays against others, else new wins."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    api = (F.col("source") == "api").cast("int")
    known = last_of(rows.filter(F.col("role").isNotNull()), ["doc_id", "name", "role"], [F.desc(api), F.desc("__new")])
    return known.unionByName(rows.filter(F.col("role").isNull())).drop("__new")


def without_roles(rows: DataFrame, doc_id: int, roles: tuple[str, ...], source: str | None = None) -> DataFrame:
    gone = (F.col("doc_id") == doc_id) & F.col("role").isin(*roles)
    if source is not None:
        gone = gone & (F.col("source") == source)
    return rows.filter(~F.coalesce(gone, F.lit(False)))


def without_orphans(citations: DataFrame, links: DataFrame) -> DataFrame:
    """Citations that some document still cites."""
    return citations.join(links.select(F.col("citation_id").alias("id")).distinct(), "id", "left_semi")


def relink(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """links with duplicate citations replaced by their canonical(id, canonical), without repeats."""
    both = links.join(canonical, links["citation_id"] == canonical["id"], "left")
    return both.select("doc_id", F.coalesce("canonical", "citation_id").alias("citation_id")).distinct()


def patch(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """rows with the given columns set where a condition holds."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})
