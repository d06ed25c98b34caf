"""Queries over what is stored and what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions.text import blocks_download, paragraphs
from corvella.operators import documents as D
from corvella.plans.registry import Registry
from corvella.sources import store as S
from corvella.sources.views import Tables

R = Registry()


@R.query("SELECT doc_id, title, year FROM (SELECT doc_id, title, year, row_number() OVER (ORDER BY lower(title) DESC, doc_id) AS n FROM docs) WHERE n <= 100")
def documents_sorted(t: Tables) -> DataFrame:
    return D.sorted_by(t.docs().select("doc_id", "title", "year"), "title", descending=True).limit(100)


@R.query("SELECT doc_id, len(p)::INTEGER AS n, p[1] AS first FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\n{2,}|\\r?\\n'), lambda x: trim(x, ' ')) AS p FROM documents)")
def document_paragraphs(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", paragraphs(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("first"))


@R.query("SELECT page_id FROM pages WHERE contains(lower(html), 'class=\"ad\"')")
def pages_by_sign(t: Tables) -> DataFrame:
    """Pages that hold a sign; here, advertisements."""
    return t.raw("pages").filter(blocks_download(F.col("html"), ('class="ad"',))).select("page_id")


@R.query("SELECT doc_id FROM documents d WHERE length(trim(text)) >= 50 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def documents_to_embed(t: Tables) -> DataFrame:
    return S.to_embed(t.raw("documents"), t.raw("embeddings").select(F.col("vec_id").alias("doc_id"))).select("doc_id")


@R.query("SELECT user_id AS job, event_type AS phase, max_by(value, (ts, event_id)) AS status, epoch_us(max(ts)) AS at FROM events GROUP BY 1, 2")
def progress_latest(t: Tables) -> DataFrame:
    events = t.raw("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("phase"), F.col("value").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return S.latest_progress(events)


@R.query("SELECT s_nationkey AS query, count(*) AS n, bool_or(s_acctbal > 9000) AS found FROM supplier GROUP BY 1")
def discovery_found(t: Tables) -> DataFrame:
    return S.any_holding(t.raw("supplier").select(F.col("s_nationkey").alias("query"), (F.col("s_acctbal") > 9000).alias("in_holdings")))
