"""All slices of a workbench from one pass: facts of documents in long form, grouped at once by all that the slices ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A slice's number of values, by kind: those that most documents have.
TOPS = {"term": 60, "method": 20, "topic": 20, "person": 30, "word": 80}


def facts(docs: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(doc_id, kind, value, year, words) of docs(doc_id, year, words, ...): a row a document with kind null, and one for each distinct value of each kind; kinds are arrays of strings, in which nulls do not count."""
    each = lambda k, v: F.transform(F.array_distinct(F.array_compact(F.coalesce(v, F.array().cast("array<string>")))), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value")))
    return docs.select("doc_id", "year", "words", F.explode(F.concat(own, *[each(k, v) for k, v in kinds.items()])).alias("f")).select("doc_id", "f.kind", "f.value", "year", "words")


def bundle(rows: DataFrame, tops: dict[str, int] = TOPS) -> DataFrame:
    """(slice, value, year, n, words): documents and their words for all slices of facts(kind, value, year, words).

    overall, by_year; and for each kind `kind` (its values in all years, the first ones by
    documents, ties by value) and `kind_by_year` (those values by year). One grouping by sets:
    a row is counted once for each of them, before anything is shuffled.
    """
    sets = [["kind"], ["kind", "year"], ["kind", "value"], ["kind", "value", "year"]]
    level = F.grouping_id("kind", "value", "year")
    # Bits of the level: 2 without value, 1 without year.
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "kind", "value", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), level.alias("level"))
    out = out.filter((F.col("level") == 3) & F.col("kind").isNull() | (F.col("level") == 2) & F.col("kind").isNull() & F.col("year").isNotNull() | (F.col("level") < 2) & F.col("kind").isNotNull())
    # A value's rows have the rank that its row of all years gives it.
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in tops.items()], F.lit(0))
    whole = F.max(F.when(F.col("level") == 1, F.col("n"))).over(W.partitionBy("kind", "value"))
    ranked = out.withColumn("whole", whole).withColumn("rank", F.dense_rank().over(W.partitionBy("kind").orderBy(F.desc("whole"), "value")))
    kept = ranked.filter(F.col("kind").isNull() | (F.col("rank") <= most) & ((F.col("level") == 1) | F.col("year").isNotNull()))
    name = F.when(F.col("level") == 3, "overall").when(F.col("level") == 2, "by_year").when(F.col("level") == 1, F.col("kind")).otherwise(F.concat("kind", F.lit("_by_year")))
    return kept.select(name.alias("slice"), "value", "year", "n", "words")
