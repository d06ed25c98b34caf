"""Queries over citations and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions.citations import citation_hash
from corvella.functions.similarity import citation_year, prefix_key
from corvella.operators import citations as C
from corvella.plans.registry import Registry
from corvella.sources.views import Tables

R = Registry()

TOP_SQL = """
SELECT d.citation_id, text, doc_count, hits, bib_id FROM (
  SELECT citation_id, count(DISTINCT doc_id) AS doc_count FROM dense_links GROUP BY citation_id HAVING count(DISTINCT doc_id) >= 2
  ORDER BY doc_count DESC, citation_id LIMIT 50) d
JOIN dense_citations c ON c.id = d.citation_id LEFT JOIN lookups l ON l.citation_id = d.citation_id"""


@R.query(TOP_SQL)
def top_cited_works(t: Tables) -> DataFrame:
    return C.top_cited(t.dense_links(), t.dense_citations(), t.lookups())


@R.query("""
SELECT s.citation_id, text, total_docs, hits FROM (
  SELECT citation_id, count(DISTINCT doc_id) AS total_docs FROM dense_links
  WHERE citation_id IN (SELECT citation_id FROM dense_links WHERE doc_id = 7) GROUP BY citation_id) s
JOIN dense_citations c ON c.id = s.citation_id LEFT JOIN lookups l ON l.citation_id = s.citation_id""")
def document_citations_with_sharing(t: Tables) -> DataFrame:
    return C.with_sharing(t.dense_links(), t.dense_citations(), t.lookups(), 7)


@R.query("SELECT c.id, c.text, c.year FROM links l JOIN citations c ON c.id = l.citation_id WHERE l.doc_id = 7")
def document_citations(t: Tables) -> DataFrame:
    own = t.links().filter("doc_id = 7")
    return own.join(t.citations(), own["citation_id"] == F.col("id")).select("id", "text", "year")


@R.query("SELECT d.doc_id, title, author, year FROM dense_links l JOIN docs d USING (doc_id) WHERE citation_id = 3")
def documents_citing(t: Tables) -> DataFrame:
    return C.citing(t.dense_links(), t.docs(), 3)


PAIRS_SQL = """
WITH best AS (SELECT citation_id FROM (SELECT citation_id, count(*) AS n FROM dense_links GROUP BY citation_id ORDER BY n DESC, citation_id LIMIT 50)),
pairs AS (
  SELECT a.citation_id AS id_a, b.citation_id AS id_b, count(*) AS shared FROM dense_links a JOIN dense_links b ON a.doc_id = b.doc_id AND a.citation_id < b.citation_id
  WHERE a.citation_id IN (SELECT citation_id FROM best) AND b.citation_id IN (SELECT citation_id FROM best)
  GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY shared DESC, id_a, id_b LIMIT 100),
named AS (SELECT id_a, id_b, substr(x.text, 1, 80) AS text_a, substr(y.text, 1, 80) AS text_b, shared FROM pairs JOIN dense_citations x ON x.id = id_a JOIN dense_citations y ON y.id = id_b)
"""


@R.query(PAIRS_SQL + "SELECT * FROM named")
def citation_cooccurrence(t: Tables) -> DataFrame:
    return C.cocited(t.dense_links(), t.dense_citations())


@R.query(PAIRS_SQL + "SELECT id, text, count(*) AS degree FROM (SELECT id_a AS id, text_a AS text FROM named UNION ALL SELECT id_b, text_b FROM named) GROUP BY id, text")
def citation_network_nodes(t: Tables) -> DataFrame:
    return C.network_nodes(C.cocited(t.dense_links(), t.dense_citations()))


PENDING_SQL = """
SELECT id, text, 'retry' AS why FROM lookups JOIN dense_citations ON id = citation_id WHERE hits IS NULL AND query_title IS NOT NULL
UNION ALL SELECT id, text, 'new' AS why FROM dense_citations c WHERE NOT EXISTS (SELECT 1 FROM lookups l WHERE l.citation_id = c.id)"""


@R.query(PENDING_SQL)
def pending_lookups(t: Tables) -> DataFrame:
    return C.pending(t.dense_citations(), t.lookups())


@R.query(f"SELECT why, count(*) AS n FROM ({PENDING_SQL}) GROUP BY why")
def pending_count(t: Tables) -> DataFrame:
    return C.pending(t.dense_citations(), t.lookups()).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@R.query("""
SELECT citations, looked_up, held, absent, retryable, citations - looked_up + retryable AS pending FROM (
  SELECT (SELECT count(*) FROM dense_citations) AS citations, count(*) AS looked_up, count(*) FILTER (WHERE hits > 0) AS held,
         count(*) FILTER (WHERE hits = 0) AS absent, count(*) FILTER (WHERE hits IS NULL AND query_title IS NOT NULL) AS retryable FROM lookups)""")
def catalogue_lookup_stats(t: Tables) -> DataFrame:
    return C.lookup_statistics(t.dense_citations(), t.lookups())


@R.query("SELECT doc_id, count(*) AS citation_count FROM links GROUP BY doc_id")
def citation_counts(t: Tables) -> DataFrame:
    return t.links().groupBy("doc_id").agg(F.count(F.lit(1)).alias("citation_count"))


@R.query("SELECT (SELECT count(*) FROM citations) AS citations, count(*) AS links, count(DISTINCT doc_id) AS documents FROM links")
def citation_totals(t: Tables) -> DataFrame:
    none = F.lit(None).cast("long")
    rows = t.links().select(none.alias("c"), "doc_id").unionByName(t.citations().select(F.col("id").alias("c"), none.alias("doc_id")))
    return rows.agg(F.count("c").alias("citations"), F.count("doc_id").alias("links"), F.countDistinct("doc_id").alias("documents"))


@R.query("SELECT citation_id, CASE WHEN hits IS NULL THEN 'none' WHEN hits > 0 THEN CASE WHEN bib_id IS NOT NULL THEN 'held_link' ELSE 'held' END ELSE 'check' END AS status FROM lookups")
def citation_status(t: Tables) -> DataFrame:
    return C.status(t.lookups())


HASHED = "sha1(trim(regexp_replace(regexp_replace(lower(replace(text, '#', ' the ')), '\\bthe\\b\\s*', '', 'g'), '\\s+', ' ', 'g')))"


@R.query(f"SELECT h AS hash, count(*) AS n, min(id) AS canonical FROM (SELECT id, {HASHED} AS h FROM citations) GROUP BY h HAVING count(*) > 1")
def citation_hash_groups(t: Tables) -> DataFrame:
    """Citations that are one after normalisation, with the smallest id of each group."""
    text = F.replace(F.col("text"), F.lit("#"), F.lit(" the "))
    return t.citations().select("id", citation_hash(text).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("canonical")).filter(F.col("n") > 1)


def _texts(t: Tables) -> DataFrame:
    """Whole citations with a year each."""
    return t.citations().select("id", F.concat_ws(" ", "text", (F.lit(1950) + F.col("year").cast("int")).cast("string")).alias("text"))


@R.query("""
WITH k AS (SELECT lower(substr(trim(text), 1, 3)) AS prefix, try_cast(nullif(regexp_extract(text || ' ' || (1950 + year::INTEGER), '\\b(1[89]\\d{2}|20[0-2]\\d)\\b', 1), '') AS INTEGER) AS year FROM citations)
SELECT prefix, count(*) AS n, count(DISTINCT year) AS years FROM k GROUP BY prefix""")
def fuzzy_candidates_blocked(t: Tables) -> DataFrame:
    """How many citations stand in each block of equal prefixes, and of how many years they are."""
    keyed = _texts(t).select(prefix_key(F.col("text")).alias("prefix"), citation_year(F.col("text")).alias("year"))
    return keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("year").alias("years"))


@R.query()
def fuzzy_matches_jw(t: Tables) -> DataFrame:
    """The most similar other citation of one block for each citation, from 0.9 up."""
    rows = _texts(t)
    return C.best_matches(rows, rows).select("id_new", "id_known", F.round("score", 6).alias("score"))


@R.query()
def fuzzy_canonical_map(t: Tables) -> DataFrame:
    """Citations with the first similar one before them, most cited ones first."""
    counts = t.links().groupBy("citation_id").agg(F.count(F.lit(1)).alias("n"))
    return C.cluster_first(_texts(t), counts)
