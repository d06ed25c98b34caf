"""The scholarly domain over the synthetic star schema, each view as a DataFrame and as SQL.

SQL has the same views as common table expressions; with_views() puts those that a query
names, and those that they need, in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPERVISING = ("Supervisor", "Co-Supervisor", "Committee Member")


class Tables:
    """Views over the tables of one folder. Columns that a query does not use are pruned to the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def docs(self) -> DataFrame:
        """doc_id, title, author, year, degree, program, affiliation, sync_key, synced_at: one row an order."""
        orders, people, places = self.raw("orders"), self.raw("customer"), self.raw("nation")
        joined = orders.join(people, orders["o_custkey"] == people["c_custkey"]).join(places, people["c_nationkey"] == places["n_nationkey"])
        return joined.select(
            F.col("o_orderkey").alias("doc_id"),
            F.concat_ws(" ", F.lit("Thesis"), F.col("o_orderkey").cast("string"), "c_mktsegment").alias("title"),
            F.col("c_name").alias("author"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("degree"),
            F.col("o_orderstatus").alias("program"),
            F.col("n_name").alias("affiliation"),
            F.col("c_mktsegment").alias("sync_key"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("synced_at"),
        )

    def metrics(self) -> DataFrame:
        """doc_id, page_count, word_count, body_word_count, word_source, page_source, status: one row an order with lines."""
        price = F.col("l_extendedprice").cast("decimal(15,2)")
        word = F.min("l_returnflag")
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("doc_id"))
            .agg(
                F.sum(F.col("l_quantity").cast("long")).alias("page_count"),
                F.floor(F.sum(price)).cast("long").alias("word_count"),
                F.floor(F.sum(F.when(F.col("l_linenumber") <= 2, price))).cast("long").alias("body_word_count"),
                F.when(word == "A", "metadata_text").when(word == "N", "downloaded_pdf_text").alias("word_source"),
                F.when(F.max("l_linestatus") == "F", "estimated_from_metadata_words").otherwise("downloaded_pdf").alias("page_source"),
                F.when(F.max("l_linenumber") == 1, "not_found").when(F.max("l_linenumber") == 2, "error").otherwise("cached").alias("status"),
            )
        )

    def links(self) -> DataFrame:
        """doc_id, citation_id: a document cites the parts of its lines."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("citation_id")).distinct()

    def dense_links(self) -> DataFrame:
        """doc_id, citation_id: few works, cited by many."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("citation_id")).distinct()

    def citations(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"), F.col("p_size").cast("string").alias("year"))

    def dense_citations(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))

    def lookups(self) -> DataFrame:
        """citation_id, hits (null: to be tried again), query_title, bib_id, for most of the dense citations."""
        k = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .filter("s_acctbal < 8000")
            .select(
                k.alias("citation_id"),
                F.when(k % 7 == 0, None).when(k % 3 == 0, 0).otherwise(k % 10).cast("long").alias("hits"),
                F.when(k % 14 == 0, None).otherwise(F.col("s_name")).alias("query_title"),
                F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("bib_id"),
            )
        )

    def committee(self) -> DataFrame:
        """doc_id, name, role (may be null), affiliation, source, pos: distinct names and roles of a document."""
        line, people, places = self.raw("lineitem"), self.raw("supplier"), self.raw("nation")
        n = F.col("l_linenumber")
        role = F.when(n == 1, "Supervisor").when(n == 2, "Co-Supervisor").when(n == 3, "Committee Member").when(n == 4, "University Examiner").when(n == 5, "External Examiner")
        rows = line.join(people, line["l_suppkey"] == people["s_suppkey"]).join(places, people["s_nationkey"] == places["n_nationkey"])
        source = F.when(n % 2 == 0, "api").otherwise("pdf")
        return rows.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("s_name").alias("name"), role.alias("role")).agg(F.max("n_name").alias("affiliation"), F.min(source).alias("source"), F.min(n).alias("pos"))

    def terms(self) -> DataFrame:
        """doc_id, term: the concept terms of a document."""
        line, part = self.raw("lineitem"), self.raw("part")
        return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("term")).distinct()

    def methods(self) -> DataFrame:
        """doc_id, method: the methodologies of a document."""
        line, part = self.raw("lineitem"), self.raw("part")
        return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("method")).distinct()

    def doc_topics(self) -> DataFrame:
        """doc_id, topic_id (-1: outlier), probability, x, y: topics of all embeddings, dealt to documents in turn."""
        e = self.raw("embeddings")
        orders = self.raw("orders").select(F.col("o_orderkey").alias("doc_id"))
        topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
        # The greatest number is part of the plan.
        turn = orders.withColumn("vec_id", F.col("doc_id") % e.agg(F.coalesce(F.max("vec_id"), F.lit(0)) + 1).scalar())
        return turn.join(e, "vec_id").select("doc_id", topic.alias("topic_id"), ((F.col("vec_id") % 100) / 100.0).alias("probability"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))

    def topics(self) -> DataFrame:
        """topic_id, label, doc_count."""
        return self.doc_topics().groupBy("topic_id").agg(F.count(F.lit(1)).alias("doc_count")).select("topic_id", F.concat_ws("_", F.col("topic_id").cast("string"), F.lit("topic"), (F.col("topic_id") % 4).cast("string")).alias("label"), "doc_count")


VIEWS = {
    "docs": """SELECT o_orderkey AS doc_id, concat_ws(' ', 'Thesis', o_orderkey::VARCHAR, c_mktsegment) AS title, c_name AS author, year(o_orderdate)::INTEGER AS year,
 o_orderpriority AS degree, o_orderstatus AS program, n_name AS affiliation, c_mktsegment AS sync_key, strftime(o_orderdate, '%Y-%m-%d') AS synced_at
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "metrics": """SELECT l_orderkey AS doc_id, sum(l_quantity::BIGINT)::BIGINT AS page_count, floor(sum(l_extendedprice::DECIMAL(15,2)))::BIGINT AS word_count,
 floor(sum(CASE WHEN l_linenumber <= 2 THEN l_extendedprice::DECIMAL(15,2) END))::BIGINT AS body_word_count,
 CASE min(l_returnflag) WHEN 'A' THEN 'metadata_text' WHEN 'N' THEN 'downloaded_pdf_text' END AS word_source,
 CASE max(l_linestatus) WHEN 'F' THEN 'estimated_from_metadata_words' ELSE 'downloaded_pdf' END AS page_source,
 CASE max(l_linenumber) WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' ELSE 'cached' END AS status FROM lineitem GROUP BY l_orderkey""",
    "links": "SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS citation_id FROM lineitem",
    "dense_links": "SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS citation_id FROM lineitem",
    "citations": "SELECT p_partkey AS id, concat_ws(' ', p_brand, p_name, p_type) AS text, p_size::VARCHAR AS year FROM part",
    "dense_citations": "SELECT s_suppkey AS id, s_name AS text FROM supplier",
    "lookups": """SELECT s_suppkey AS citation_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 10 END::BIGINT AS hits,
 CASE WHEN s_suppkey % 14 = 0 THEN NULL ELSE s_name END AS query_title, CASE WHEN s_suppkey % 2 = 0 THEN 'b' || s_suppkey::VARCHAR END AS bib_id
 FROM supplier WHERE s_acctbal < 8000""",
    "committee": """SELECT l_orderkey AS doc_id, s_name AS name, CASE l_linenumber WHEN 1 THEN 'Supervisor' WHEN 2 THEN 'Co-Supervisor' WHEN 3 THEN 'Committee Member'
 WHEN 4 THEN 'University Examiner' WHEN 5 THEN 'External Examiner' END AS role, max(n_name) AS affiliation,
 min(CASE WHEN l_linenumber % 2 = 0 THEN 'api' ELSE 'pdf' END) AS source, min(l_linenumber) AS pos
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "terms": "SELECT DISTINCT l_orderkey AS doc_id, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey",
    "methods": "SELECT DISTINCT l_orderkey AS doc_id, p_brand AS method FROM lineitem JOIN part ON l_partkey = p_partkey",
    "doc_topics": """SELECT o_orderkey AS doc_id, CASE WHEN label = 9 THEN -1 ELSE label END AS topic_id, (vec_id % 100) / 100.0::DOUBLE AS probability,
 embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM orders JOIN embeddings ON o_orderkey % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id""",
    "topics": "SELECT topic_id, concat_ws('_', topic_id::VARCHAR, 'topic', (topic_id % 4)::VARCHAR) AS label, count(*) AS doc_count FROM doc_topics GROUP BY topic_id",
}


def with_views(sql: str) -> str:
    """The query with the views that it uses in front; a query that starts with WITH goes on after them."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(VIEWS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    head = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in used)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
