"""Files of documents: which of a repository's files to take, texts from the cache or fetched, PDFs that may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shortest full text that counts, exclusive, and the longest PDF that is kept.
LEAST_TEXT, MOST_PDF = 1000, 200 << 20


def cache_name(seed: Column, suffix: str) -> Column:
    """The name of a stored file: a hash of what it is stored for."""
    return F.concat(F.sha1(F.coalesce(seed.cast("string"), F.lit(""))), F.lit(suffix))


def chosen_files(found: DataFrame) -> DataFrame:
    """(doc_id, text_id, text_name, pdf_id, pdf_name) of found(doc_id, pos, id, name, mime, bundle): the first file that is a text and the first that is a PDF.

    A text is one by its type, its bundle or its double ending; a PDF by its type and, beside
    that, its bundle or ending, all in any letters. Documents without either have nulls. A
    document's files are compared by a combinable minimum, so their number does not matter.
    """
    mime, bundle, name = (F.coalesce(F.col(c), F.lit("")) for c in ("mime", "bundle", "name"))
    is_text = F.startswith(F.lower(mime), F.lit("text/plain")) | (F.upper(bundle) == "TEXT") | F.endswith(F.lower(name), F.lit(".pdf.txt"))
    is_pdf = F.contains(F.lower(mime), F.lit("pdf")) & ((F.upper(bundle) == "ORIGINAL") | F.endswith(F.lower(name), F.lit(".pdf")))
    first = lambda kind: F.min(F.when(kind, F.struct("pos", "id", "name")))
    one = found.groupBy("doc_id").agg(first(is_text).alias("t"), first(is_pdf).alias("p"))
    return one.select("doc_id", F.col("t.id").alias("text_id"), F.col("t.name").alias("text_name"), F.col("p.id").alias("pdf_id"), F.col("p.name").alias("pdf_name"))


def full_texts(cached: DataFrame, fetched: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """(doc_id, full_text, path, bytes, source_url, cache_hit): the cached(doc_id, text, source_url) text if it is long enough, else the fetched one if that is.

    Documents with neither give no row. Fetched texts that are taken are those to be stored, under path.
    """
    long = lambda rows: rows.filter(F.length("text") > least).select("doc_id", "text", "source_url")
    own = long(cached).withColumn("cache_hit", F.lit(True))
    other = long(fetched).join(own.select("doc_id"), "doc_id", "left_anti").withColumn("cache_hit", F.lit(False))
    rows = own.unionByName(other)
    return rows.select("doc_id", F.col("text").alias("full_text"), cache_name(F.col("doc_id"), ".txt").alias("path"), F.octet_length("text").cast("long").alias("bytes"), "source_url", "cache_hit")


def kept_pdfs(fetched: DataFrame, most: int = MOST_PDF) -> DataFrame:
    """fetched(doc_id, url, content, content_type, name) that are PDFs by type or name, not empty and not too long, with path and bytes."""
    size = F.octet_length("content")
    typed = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("pdf")) | F.endswith(F.lower(F.coalesce("name", F.lit(""))), F.lit(".pdf"))
    seed = F.coalesce(F.nullif("url", F.lit("")), F.col("doc_id").cast("string"))
    return fetched.filter((size > 0) & (size <= most) & typed).withColumn("path", cache_name(seed, ".pdf")).withColumn("bytes", size.cast("long"))
