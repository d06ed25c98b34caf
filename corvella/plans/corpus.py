"""Queries over documents, their metrics and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions.citations import ris
from corvella.functions.names import affiliation
from corvella.operators import documents as D
from corvella.plans.registry import Registry
from corvella.sources.views import Tables

R = Registry()

BOTH = "docs LEFT JOIN metrics USING (doc_id)"
ACTIVE = "coalesce(body_word_count, word_count)"
WORDS_OK = f"(coalesce({ACTIVE} >= 1000, false) AND word_source IS DISTINCT FROM 'metadata_text')"
PAGES_OK = "(coalesce(page_count >= 10, false) AND page_source IS DISTINCT FROM 'estimated_from_metadata_words')"


def both(t: Tables) -> DataFrame:
    return D.overlay_metrics(t.docs(), t.metrics())


@R.query(f"SELECT doc_id, title, year, degree, page_count, word_count, body_word_count, status FROM {BOTH} ORDER BY year DESC NULLS LAST, title, doc_id LIMIT 1000")
def cached_documents_topn(t: Tables) -> DataFrame:
    top = D.newest(t.docs(), 1000)
    return D.overlay_metrics(top, t.metrics()).select("doc_id", "title", "year", "degree", "page_count", "word_count", "body_word_count", "status")


@R.query("SELECT doc_id, title, year FROM docs WHERE sync_key = 'BUILDING' ORDER BY year DESC NULLS LAST, title, doc_id LIMIT 200")
def cached_documents_of_key(t: Tables) -> DataFrame:
    return D.newest(t.docs(), 200, "BUILDING").select("doc_id", "title", "year")


@R.query("SELECT d.doc_id, d.title, coalesce(n, 0) AS citation_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM links GROUP BY doc_id) c ON c.doc_id = d.doc_id")
def documents_with_citation_counts(t: Tables) -> DataFrame:
    return D.overlay_counts(t.docs(), t.links()).select("doc_id", "title", "citation_count")


@R.query("SELECT count(*) AS n, count(*) FILTER (WHERE status = 'cached') AS cached, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status = 'not_found') AS missing, min(page_count) AS least_pages, max(page_count) AS most_pages FROM metrics")
def file_metric_stats(t: Tables) -> DataFrame:
    s = F.col("status")
    return t.metrics().agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s == "cached").alias("cached"),
        F.count_if(s == "error").alias("failed"),
        F.count_if(s == "not_found").alias("missing"),
        F.min("page_count").alias("least_pages"),
        F.max("page_count").alias("most_pages"),
    )


@R.query("SELECT sync_key, count(*) AS n, max(synced_at) AS last_synced FROM docs GROUP BY sync_key")
def document_cache_stats(t: Tables) -> DataFrame:
    return t.docs().groupBy("sync_key").agg(F.count(F.lit(1)).alias("n"), F.max("synced_at").alias("last_synced"))


@R.query("SELECT DISTINCT 'degree' AS field, degree AS value FROM docs UNION SELECT 'program', program FROM docs UNION SELECT 'affiliation', affiliation FROM docs")
def facet_values(t: Tables) -> DataFrame:
    return D.facet_values(t.docs(), ("degree", "program", "affiliation"))


@R.query("SELECT affiliation AS value, count(*) AS n FROM docs WHERE affiliation <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def facet_buckets(t: Tables) -> DataFrame:
    return D.facet_buckets(t.docs(), "affiliation")


@R.query("SELECT doc_id, title, degree, program, affiliation FROM docs WHERE degree = '1-URGENT' AND program = 'O' AND affiliation = 'NATION_3'")
def facet_filtered_docs(t: Tables) -> DataFrame:
    return D.facet_filter(t.docs(), "1-URGENT", "O", "NATION_3").select("doc_id", "title", "degree", "program", "affiliation")


@R.query("SELECT affiliation AS raw, trim(regexp_replace(affiliation, '\\s+', ' ', 'g')) AS affiliation, count(*) AS n FROM docs GROUP BY 1, 2")
def affiliation_normalised(t: Tables) -> DataFrame:
    return t.docs().groupBy(F.col("affiliation").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", affiliation(F.col("raw")).alias("affiliation"), "n")


STATS = "count(v) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean"


@R.query(f"SELECT measure, {STATS} FROM (SELECT 'words' AS measure, CASE WHEN {WORDS_OK} THEN {ACTIVE} END AS v FROM {BOTH} UNION ALL SELECT 'pages', CASE WHEN {PAGES_OK} THEN page_count END FROM {BOTH}) GROUP BY measure")
def overall_stats(t: Tables) -> DataFrame:
    return D.overall(both(t))


@R.query(f"SELECT count(*) AS documents, min(page_count) AS least_pages, max(page_count) AS most_pages, round(avg(page_count), 6) AS mean_pages, min({ACTIVE}) AS least_words, max({ACTIVE}) AS most_words, round(avg({ACTIVE}), 6) AS mean_words FROM {BOTH}")
def kpi_cards(t: Tables) -> DataFrame:
    w = D.active_words()
    return both(t).agg(
        F.count(F.lit(1)).alias("documents"),
        F.min("page_count").alias("least_pages"),
        F.max("page_count").alias("most_pages"),
        F.round(F.avg("page_count"), 6).alias("mean_pages"),
        F.min(w).alias("least_words"),
        F.max(w).alias("most_words"),
        F.round(F.avg(w), 6).alias("mean_words"),
    )


@R.query("SELECT count(n) AS documents, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM links GROUP BY doc_id HAVING count(*) >= 5)")
def kpi_citations(t: Tables) -> DataFrame:
    n = t.links().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return n.agg(F.count("n").alias("documents"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


YEARLY = f"SELECT year, {STATS}, median(v) AS middle FROM (SELECT year, %s AS v FROM {BOTH} WHERE year <> 0 AND %s) GROUP BY year"


@R.query(YEARLY % (ACTIVE, WORDS_OK))
def words_by_year(t: Tables) -> DataFrame:
    return D.by_year(both(t), D.active_words(), D.reliable_words())


@R.query(f"SELECT year, n, least, most, mean FROM ({YEARLY % ('page_count', PAGES_OK)})")
def pages_by_year(t: Tables) -> DataFrame:
    return D.by_year(both(t), F.col("page_count"), D.reliable_pages()).drop("middle")


@R.query(f"SELECT year, middle, least, most, n FROM ({YEARLY % ('page_count', PAGES_OK)})")
def page_trend_by_year(t: Tables) -> DataFrame:
    return D.by_year(both(t), F.col("page_count"), D.reliable_pages()).select("year", "middle", "least", "most", "n")


FILLED = """
WITH c AS (SELECT degree, year, count(*) AS n FROM docs WHERE year IS NOT NULL AND NOT (degree = '5-LOW' AND year = 1996) GROUP BY 1, 2)
SELECT d.degree, y.year, coalesce(n, 0) AS n FROM (SELECT DISTINCT degree FROM c) d CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c ON c.degree = d.degree AND c.year = y.year"""


@R.query(FILLED)
def year_series_zero_filled(t: Tables) -> DataFrame:
    counts = t.docs().filter(F.col("year").isNotNull() & ~((F.col("degree") == "5-LOW") & (F.col("year") == 1996))).groupBy("degree", "year").agg(F.count(F.lit(1)).alias("n"))
    return D.zero_filled(counts, "degree", "year", "n")


@R.query("SELECT doc_id, title, author, year FROM docs WHERE contains(lower(title), 'machinery') OR contains(lower(author), 'machinery')")
def free_text_search(t: Tables) -> DataFrame:
    return D.free_text(t.docs(), "Machinery", ("title", "author")).select("doc_id", "title", "author", "year")


@R.query("SELECT d.doc_id, title FROM docs d WHERE EXISTS (SELECT 1 FROM terms x WHERE x.doc_id = d.doc_id AND term = (SELECT min(term) FROM terms)) AND EXISTS (SELECT 1 FROM terms x WHERE x.doc_id = d.doc_id AND term = (SELECT max(term) FROM terms))")
def drilldown_pair(t: Tables) -> DataFrame:
    """Documents that have both of two terms: the first and the last of all."""
    ends = t.terms().agg(F.min("term").alias("a"), F.max("term").alias("b")).first()
    of = lambda x: t.terms().filter(F.col("term") == x).select("doc_id")
    return t.docs().join(of(ends["a"]), "doc_id", "left_semi").join(of(ends["b"]), "doc_id", "left_semi").select("doc_id", "title")


@R.query("SELECT doc_id, concat_ws(chr(10), 'TY  - THES', 'TI  - ' || title, 'AU  - ' || author, 'PY  - ' || year::VARCHAR, 'AB  - ' || degree, 'ER  - ') AS record FROM docs")
def export_ris(t: Tables) -> DataFrame:
    return t.docs().select("doc_id", ris(F.lit("THES"), F.col("title"), F.col("author"), F.col("year"), F.col("degree")).alias("record"))


@R.query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_projection(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@R.query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INTEGER AS n_links FROM pages")
def markup_fields(t: Tables) -> DataFrame:
    """Fields cut out of marked-up pages by pattern."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return t.raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("n_links"))
