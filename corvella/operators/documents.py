"""Document overlays, facets, reliability and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions.names import affiliation


def overlay_metrics(docs: DataFrame, metrics: DataFrame) -> DataFrame:
    """docs with the stored metrics of those that have any; others keep nulls. One equi-join on doc_id."""
    return docs.join(metrics, "doc_id", "left")


def overlay_counts(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs with citation_count, 0 where nothing is linked. Links are counted before the join."""
    counts = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("citation_count"))
    return docs.join(counts, "doc_id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0).cast("long")))


def newest(docs: DataFrame, limit: int, sync_key: str | None = None) -> DataFrame:
    """The first rows by year, newest first, then title; of one sync key if given."""
    rows = docs if sync_key is None else docs.filter(F.col("sync_key") == sync_key)
    return rows.orderBy(F.desc("year"), "title", "doc_id").limit(limit)


def facet_filter(docs: DataFrame, degree: str | None = None, program: str | None = None, place: str | None = None) -> DataFrame:
    """Rows that equal every given facet; a place also matches by its normal form."""
    out = docs
    if degree:
        out = out.filter(F.col("degree") == degree)
    if program:
        out = out.filter(F.col("program") == program)
    if place:
        out = out.filter((F.col("affiliation") == place) | (affiliation(F.col("affiliation")) == affiliation(F.lit(place))))
    return out


def facet_buckets(docs: DataFrame, field: str, limit: int = 100) -> DataFrame:
    """value, n: the most frequent values that are not empty."""
    rows = docs.filter(F.col(field).isNotNull() & (F.col(field) != ""))
    return rows.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facet_values(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, value: distinct values of each field, from one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return docs.select(each.alias("x")).select("x.field", "x.value").filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def active_words() -> Column:
    return F.coalesce("body_word_count", "word_count")


def reliable_words(least: int = 1000) -> Column:
    """Enough words, from another source than the metadata text; an unknown source counts as reliable."""
    return F.coalesce(active_words() >= least, F.lit(False)) & ~F.col("word_source").eqNullSafe("metadata_text")


def reliable_pages(least: int = 10) -> Column:
    return F.coalesce(F.col("page_count") >= least, F.lit(False)) & ~F.col("page_source").eqNullSafe("estimated_from_metadata_words")


def statistics(value: Column) -> list[Column]:
    """count, min, max and mean, the last three null where there is nothing."""
    return [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean")]


def overall(docs: DataFrame) -> DataFrame:
    """One row a measure (words, pages) over reliable rows."""
    rows = docs.select(F.when(reliable_words(), active_words()).alias("w"), F.when(reliable_pages(), F.col("page_count")).alias("p"))
    long = rows.select(F.explode(F.array(F.struct(F.lit("words").alias("measure"), F.col("w").alias("v")), F.struct(F.lit("pages").alias("measure"), F.col("p").alias("v")))).alias("x")).select("x.measure", "x.v")
    return long.groupBy("measure").agg(*statistics(F.col("v")))


def by_year(docs: DataFrame, value: Column, reliable: Column) -> DataFrame:
    """Statistics and median of the reliable values of each year; years without any are left out."""
    rows = docs.filter(F.col("year").isNotNull() & (F.col("year") != 0) & reliable).select("year", value.alias("v"))
    return rows.groupBy("year").agg(*statistics(F.col("v")), F.median("v").alias("middle"))


def zero_filled(counts: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """counts(series, step, value) with 0 where a series lacks a step of any other.

    Steps are few (years), so each series' row carries them all and no cross join is needed.
    """
    steps = counts.agg(F.array_sort(F.collect_set(step)).alias("steps")).first()["steps"]
    wide = counts.groupBy(series).agg(F.map_from_entries(F.collect_list(F.struct(step, value))).alias("m"))
    every = F.explode(F.array(*[F.lit(s).cast(counts.schema[step].dataType) for s in steps])) if steps else F.explode(F.array().cast("array<int>"))
    return wide.withColumn(step, every).select(series, step, F.coalesce(F.element_at("m", F.col(step)), F.lit(0).cast("long")).alias(value))


def free_text(docs: DataFrame, needle: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of which any field holds the needle, whatever the case."""
    low = needle.lower()
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(low)), F.lit(False))
    return docs.filter(found)


def sorted_by(docs: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """docs in the order of a column: texts without case, missing values as '' or 0, ties by id."""
    kind = docs.schema[key].dataType.typeName()
    value = F.lower(F.coalesce(F.col(key), F.lit(""))) if kind == "string" else F.coalesce(F.col(key), F.lit(0))
    return docs.orderBy(value.desc() if descending else value.asc(), "doc_id")
