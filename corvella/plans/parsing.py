"""Queries over full texts: bibliographies, committees and search terms. The prose of the tables has none, so some wrap it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import parsers as P
from corvella.plans.registry import Registry
from corvella.sources.views import Tables

R = Registry()


@R.query("""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'REFERENCES' || chr(10) || 'Smith, J. (2012). Learning Educational Theory. Journal.' ELSE '' END AS text, text AS body FROM documents)
SELECT doc_id, nullif(len(regexp_extract_all(body, '\\S+')), 0)::BIGINT AS words FROM t""")
def body_word_counts(t: Tables) -> DataFrame:
    """Words before the bibliography, which a third of the texts are given."""
    tail = F.when(F.col("doc_id") % 3 == 0, "\nREFERENCES\nSmith, J. (2012). Learning Educational Theory. Journal.").otherwise("")
    return t.raw("documents").select("doc_id", P.body_word_count(F.concat("text", tail)).alias("words"))


def _full_texts(t: Tables) -> DataFrame:
    """Short theses: a certification page, a body and a bibliography, from committee and titles."""
    people = t.committee().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.regexp_replace("name", "[#0-9]+", " Name"), F.lit(" ("), "role", F.lit(")")))), "\n").alias("page"))
    rows = t.docs().join(people, "doc_id")
    body = F.concat(F.lit("The following individuals certify that they have read the thesis\n"), "page", F.lit("\nAbstract\n"), "title")
    books = F.concat(F.lit("\nREFERENCES\n\nSmith, J. ("), F.col("year").cast("string"), F.lit("). Learning in "), "affiliation", F.lit(" and elsewhere: a study. Journal of Education, 12(3), 45-67.\n\nAppendix A"))
    return rows.select("doc_id", F.concat(body, books).alias("text"))


@R.query("SELECT doc_id, 'Smith, J. (' || year::VARCHAR || '). Learning in ' || affiliation || ' and elsewhere: a study. Journal of Education, 12(3), 45-67.' AS entry FROM docs WHERE doc_id IN (SELECT doc_id FROM committee)")
def bibliography_entries(t: Tables) -> DataFrame:
    return _full_texts(t).select("doc_id", F.explode(P.bibliography_entries("text")).alias("entry"))


@R.query("SELECT DISTINCT doc_id, regexp_replace(name, '[#0-9]+', ' Name') AS name, role FROM committee WHERE role IN ('Supervisor', 'Co-Supervisor', 'University Examiner', 'External Examiner')")
def committee_members_parsed(t: Tables) -> DataFrame:
    members = _full_texts(t).select("doc_id", F.inline(P.committee_members("text")))
    return members.select("doc_id", "name", "role").distinct()


@R.query("SELECT doc_id, 'Smith' AS author, 'Learning in ' || replace(affiliation, '_', '') || ' and elsewhere' AS title FROM docs WHERE doc_id IN (SELECT doc_id FROM committee)")
def search_terms(t: Tables) -> DataFrame:
    return bibliography_entries(t).select("doc_id", P.citation_terms("entry").alias("x")).select("doc_id", "x.author", "x.title")
