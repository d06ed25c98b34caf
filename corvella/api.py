"""One entry to the analytics of a corpus: each method gives lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators import citations, documents, people, terms, topics
from corvella.operators.runs import checked
from corvella.sources.views import SUPERVISING, Tables


class CorpusAnalytics:
    """Slices of one corpus view: the newest `limit` documents (all if None), then facets, as filters of later methods."""

    def __init__(self, tables: Tables, limit: int | None = None, **facets: str):
        if wrong := checked(max_records=limit):
            raise ValueError(" ".join(wrong))
        self.tables, self.limit, self.facets = tables, limit, facets

    @cached_property
    def documents(self) -> DataFrame:
        """Documents with metrics and citation counts. The limit comes before the facets, as it is part of the scan."""
        rows = self.tables.docs() if self.limit is None else documents.newest(self.tables.docs(), self.limit)
        rows = documents.facet_filter(rows, self.facets.get("degree"), self.facets.get("program"), self.facets.get("affiliation"))
        return documents.overlay_counts(documents.overlay_metrics(rows, self.tables.metrics()), self.tables.links())

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows if self.limit is None and not self.facets else rows.join(self.documents.select("doc_id"), "doc_id", "left_semi")

    def bootstrap(self) -> DataFrame:
        """The lean row of each document."""
        return self.documents.select("doc_id", "title", "author", "year", "degree", "program", "page_count", "word_count", "citation_count")

    def document(self, doc_id: int) -> dict[str, DataFrame]:
        t = self.tables
        return {
            "document": self.documents.filter(F.col("doc_id") == doc_id),
            "citations": citations.with_sharing(t.dense_links(), t.dense_citations(), t.lookups(), doc_id),
            "committee": t.committee().filter(F.col("doc_id") == doc_id),
            "related": terms.related(t.terms(), t.docs(), doc_id),
        }

    def facets_of(self) -> DataFrame:
        return documents.facet_values(self.documents, ("degree", "program", "affiliation"))

    def analytics(self, subject_limit: int = 25) -> dict[str, DataFrame]:
        if wrong := checked(subject_limit=subject_limit):
            raise ValueError(" ".join(wrong))
        d, own = self.documents, self._of(self.tables.terms())
        return {
            "overall": documents.overall(d),
            "by_year": documents.by_year(d, documents.active_words(), documents.reliable_words()),
            "pages_by_year": documents.by_year(d, F.col("page_count"), documents.reliable_pages()),
            "by_concept": terms.weighted_length(d, own, subject_limit),
            "concept_cloud": terms.concept_cloud(own),
        }

    def visualizations(self) -> dict[str, DataFrame]:
        t, own = self.tables, self._of(self.tables.terms())
        methods, placed = self._of(t.methods()), self._of(t.doc_topics())
        led = self._of(t.committee().filter(F.col("role").isin("Supervisor", "Co-Supervisor")).select("doc_id", "name").distinct())
        return {
            "timeline": terms.timeline(own, self.documents),
            "supervisor_concepts": terms.matrix(led, own, "name", "term", 12, 10),
            "methodology_concepts": terms.matrix(methods, own, "method", "term", 10, 10),
            "methodology_topics": terms.matrix(methods, placed.filter("topic_id <> -1"), "method", "topic_id", 10, 8),
            "topics_by_year": topics.by_year(placed, self.documents),
            "cocitations": citations.cocited(self._of(t.dense_links()), t.dense_citations()),
        }

    def people(self) -> dict[str, DataFrame]:
        own = self._of(self.tables.committee())
        admitted = own.filter(F.coalesce("role", F.lit("Committee Member")).isin(*SUPERVISING)).select("doc_id", "name").distinct()
        nodes, edges = terms.people_network(admitted)
        return {"people": people.person_list(own, self.documents), "nodes": nodes, "edges": edges}

    def top_cited(self, limit: int = 50) -> DataFrame:
        t = self.tables
        return citations.top_cited(self._of(t.dense_links()), t.dense_citations(), t.lookups(), min(limit, 200))

    def citing(self, citation_id: int) -> DataFrame:
        return citations.citing(self.tables.dense_links(), self.documents, citation_id)
