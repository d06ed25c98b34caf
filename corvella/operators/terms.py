"""Aggregations over the terms, methods, people and topics of documents. Matrices and graphs are in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.functions.text import low_signal_term, tenth
from corvella.functions.vocabulary import PAIR_BLOCKLIST
from corvella.operators.documents import active_words, reliable_words


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """column, n: its k most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def concept_cloud(terms: DataFrame, k: int = 60) -> DataFrame:
    """term, n: the most frequent concept terms, without boilerplate. Terms are judged once each, after counting."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(~F.col("term").isin(*PAIR_BLOCKLIST) & ~low_signal_term(F.col("term"))).orderBy(F.desc("n"), "term").limit(k)


def timeline(terms: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """term, year, n: documents a year for the k most frequent terms."""
    best = top(terms.filter(~F.col("term").isin(*PAIR_BLOCKLIST)), "term", k).select("term")
    return terms.join(F.broadcast(best), "term").join(docs.filter(F.col("year").isNotNull()).select("doc_id", "year"), "doc_id").groupBy("term", "year").agg(F.count(F.lit(1)).alias("n"))


def weighted_length(docs: DataFrame, terms: DataFrame, k: int = 25) -> DataFrame:
    """term, doc_count, doc_equivalent, weighted_mean: words of a term's documents, each weighing one over its number of terms."""
    sizes = terms.groupBy("doc_id").agg((1 / F.count(F.lit(1))).alias("w"))
    words = docs.select("doc_id", F.when(reliable_words(), active_words()).alias("words"))
    rows = terms.join(sizes, "doc_id").join(words, "doc_id")
    known = F.when(F.col("words").isNotNull(), F.col("w"))
    out = rows.groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"), F.round(F.sum("w"), 6).alias("doc_equivalent"), F.round(F.sum(F.col("words") * F.col("w")) / F.sum(known), 4).alias("weighted_mean"))
    return out.orderBy(F.desc("doc_count"), F.desc(F.coalesce("weighted_mean", F.lit(0.0))), "term").limit(k)


def lift(terms: DataFrame, n_docs: int, k: int = 20, least: int = 2, fragment: float = 0.7) -> DataFrame:
    """term_a, term_b, n, lift: pairs of terms that occur together more than by chance.

    Documents with one term only do not count. A pair that is nearly always together is taken
    for one phrase and left out. Equal documents' term sets are counted once with their number
    before pairs are made, so a set that many documents share is paired once.
    """
    sets = terms.filter(~F.col("term").isin(*PAIR_BLOCKLIST)).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("ts")).filter(F.size("ts") >= 2)
    counted = sets.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    singles = counted.select(F.explode("ts").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("f"))
    pair = F.explode(F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice(F.col("ts"), i + 2, F.size("ts")), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    pairs = counted.select(pair.alias("p"), "n").groupBy(F.col("p.a").alias("term_a"), F.col("p.b").alias("term_b")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    fa, fb = singles.withColumnsRenamed({"term": "term_a", "f": "fa"}), singles.withColumnsRenamed({"term": "term_b", "f": "fb"})
    both = pairs.join(fa, "term_a").join(fb, "term_b").filter(F.col("n") / F.least("fa", "fb") < fragment)
    exact = F.col("n") * n_docs / (F.col("fa") * F.col("fb"))
    return both.withColumn("x", exact).orderBy(F.desc("x"), F.desc("n"), "term_a", "term_b").limit(k).select("term_a", "term_b", "n", tenth(F.col("x")).alias("lift"))


def matrix(left: DataFrame, right: DataFrame, row: str, column: str, n_rows: int, n_columns: int) -> DataFrame:
    """row, column, n: how many documents the most frequent rows share with the most frequent columns; zeros are left out.

    Both sides are cut to their top values before they meet on doc_id.
    """
    a = left.join(F.broadcast(top(left, row, n_rows).select(row)), row, "left_semi")
    b = right.join(F.broadcast(top(right, column, n_columns).select(column)), column, "left_semi")
    return a.join(b, "doc_id").groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def people_network(people: DataFrame, k: int = 30, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, doc_count) and edges (a, b, weight) of the k people with most documents; people(doc_id, name) is distinct."""
    nodes = top(people, "name", k).withColumnRenamed("n", "doc_count")
    kept = people.join(F.broadcast(nodes.select("name")), "name", "left_semi")
    a, b = kept.select("doc_id", F.col("name").alias("a")), kept.select("doc_id", F.col("name").alias("b"))
    edges = a.join(b, "doc_id").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)
    return nodes, edges


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def related(terms: DataFrame, docs: DataFrame, doc_id: int, k: int = 6) -> DataFrame:
    """The documents that share most terms with one, newest first among equals."""
    own = terms.filter(F.col("doc_id") == doc_id).select("term")
    shared = terms.filter(F.col("doc_id") != doc_id).join(F.broadcast(own), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.join(docs.select("doc_id", "year"), "doc_id").orderBy(F.desc("overlap"), F.desc("year"), "doc_id").limit(k)


def related_weighted(terms: DataFrame, methods: DataFrame, topics: DataFrame, doc_id: int, k: int = 6) -> DataFrame:
    """Documents by 2 for each shared term, 0.5 for each shared method, and up to 2.5 for the same topic, outliers apart."""
    own = F.col("doc_id") == doc_id

    def score(rows: DataFrame, column: str, weight: float) -> DataFrame:
        return rows.filter(~own).join(F.broadcast(rows.filter(own).select(column)), column).groupBy("doc_id").agg((F.count(F.lit(1)) * weight).alias("s"))

    mine = topics.filter(own).select("topic_id", F.coalesce("probability", F.lit(0.75)).alias("p"))
    same = topics.filter(~own & (F.col("topic_id") != -1)).join(F.broadcast(mine), "topic_id").select("doc_id", (2.5 * F.least("p", F.coalesce("probability", F.lit(0.75)))).alias("s"))
    every = score(terms, "term", 2.0).unionByName(score(methods, "method", 0.5)).unionByName(same)
    return every.groupBy("doc_id").agg(F.round(F.sum("s"), 6).alias("score")).filter(F.col("score") > 0).orderBy(F.desc("score"), "doc_id").limit(k)


def ratio_to_max(rows: DataFrame, n: str) -> DataFrame:
    """rows with ratio, n against the largest of the whole result; for results cut to a top-k."""
    return rows.withColumn("ratio", F.round(F.col(n) / F.greatest(F.lit(1), F.max(n).over(W.partitionBy())), 6))
