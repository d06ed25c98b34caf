"""People of a corpus: roles, affiliations, documents and co-workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.functions.names import ascii_key, person_name, valid_person


def named(committee: DataFrame, key=ascii_key) -> DataFrame:
    """committee with name in its usual form, and key; rows without a valid name are left out."""
    rows = committee.withColumn("name", person_name(F.col("name"))).filter(F.col("name").isNotNull())
    return rows.filter(valid_person(F.col("name"))).withColumn("key", key(F.col("name")))


def person_list(committee: DataFrame, docs: DataFrame) -> DataFrame:
    """key, name, roles, affiliations, doc_count, first_year, last_year: one row a person."""
    # A name recurs in many documents: each is brought into form once.
    forms = named(committee.select(F.col("name").alias("raw"), "name").distinct()).select("raw", "name", "key")
    rows = committee.withColumnRenamed("name", "raw").join(forms, "raw").join(docs.select("doc_id", "year"), "doc_id")
    return rows.groupBy("key").agg(
        F.min("name").alias("name"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("role", F.lit("Committee Member")))), "; ").alias("roles"),
        F.array_join(F.array_sort(F.collect_set("affiliation")), "; ").alias("affiliations"),
        F.countDistinct("doc_id").alias("doc_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def year_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def top_terms(people: DataFrame, terms: DataFrame, k: int = 12) -> DataFrame:
    """name, rank, term, n: each person's most frequent terms; people(doc_id, name) is distinct."""
    counts = people.join(terms, "doc_id").groupBy("name", "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("name", "rank", "term", "n")


def co_workers(people: DataFrame, name: str) -> DataFrame:
    """name, n: with whom one person shares documents."""
    own = people.filter(F.col("name") == name).select("doc_id")
    return people.filter(F.col("name") != name).join(own, "doc_id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def by_role(committee: DataFrame, without: tuple[str, ...] = ("Supervisor", "Co-Supervisor")) -> DataFrame:
    """doc_id, role, names: each document's members that do not supervise, joined by role."""
    rows = committee.withColumn("role", F.coalesce("role", F.lit("Committee Member"))).filter(~F.col("role").isin(*without))
    return rows.groupBy("doc_id", "role").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def merged_affiliations(rows: DataFrame) -> DataFrame:
    """key, affiliation of rows(key, affiliation): those whose words all stand in a longer one of the same key go."""
    words = F.array_distinct(F.split(F.lower("affiliation"), r"\W+"))
    own = rows.distinct().withColumn("w", words)
    lists = own.groupBy("key").agg(F.collect_list(F.struct("affiliation", "w")).alias("all"))
    covers = lambda x, y: (F.size(F.array_except(x["w"], y["w"])) == 0) & (F.size(x["w"]) < F.size(y["w"]))
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: covers(x, y)))
    return lists.select("key", F.explode(F.transform(kept, lambda x: x["affiliation"])).alias("affiliation"))


def profile(people: DataFrame, docs: DataFrame, terms: DataFrame, methods: DataFrame, name: str, k: int = 12) -> DataFrame:
    """One row of a supervisor: name, doc_count, years, terms and methods (each joined with counts, most frequent first)."""
    own = people.filter(F.col("name") == name).select("doc_id").distinct()
    none = F.lit(None)

    def counted(rows: DataFrame, value: str, kind: str, limit: int | None) -> DataFrame:
        counts = rows.join(own, "doc_id", "left_semi").groupBy(value).agg(F.count(F.lit(1)).alias("n"))
        best = counts if limit is None else counts.orderBy(F.desc("n"), value).limit(limit)
        return best.select(F.lit(kind).alias("kind"), F.col(value).alias("v"), "n", none.cast("int").alias("year"))

    dated = docs.join(own, "doc_id", "left_semi").select(F.lit("doc").alias("kind"), none.cast("string").alias("v"), none.cast("long").alias("n"), F.col("year").cast("int").alias("year"))
    every = dated.unionByName(counted(terms, "term", "term", k)).unionByName(counted(methods, "method", "method", None))

    def listed(kind: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("less"), F.col("v").alias("v")))))
        return F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["v"], (-x["less"]).cast("string"))), "; ")

    years = F.coalesce(year_range(F.min("year"), F.max("year")), F.lit("-"))
    return every.agg(F.count_if(F.col("kind") == "doc").alias("doc_count"), years.alias("years"), listed("term").alias("terms"), listed("method").alias("methods")).select(F.lit(name).alias("name"), "doc_count", "years", "terms", "methods")
