"""Queries over records, exports, formats and label states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import citations as C
from corvella.functions import parsers as X
from corvella.functions.parsers import junk_citation
from corvella.functions.text import canonicalise
from corvella.operators import files as K
from corvella.operators import people as P
from corvella.operators import phrases as H
from corvella.operators import records as D
from corvella.operators import topics as O
from corvella.operators.cut import cut
from corvella.operators.merge import upsert
from corvella.plans.people import dotted
from corvella.plans.registry import Registry
from corvella.plans.subjects import SUPERVISORS, supervisors
from corvella.plans.texts import TF
from corvella.sources import hits as S
from corvella.sources.views import Tables

R = Registry()

# Sinks and merges.


@R.query("SELECT doc_id, pos, name FROM (SELECT doc_id, pos, CASE WHEN affiliation = 'NATION_3' THEN 'Examining Committee' ELSE name END AS name FROM committee) WHERE lower(name) <> 'examining committee'")
def committee_purged(t: Tables) -> DataFrame:
    """The committee without headings; here, those of one country stand for headings that were read as names."""
    name = F.when(F.col("affiliation") == "NATION_3", "Examining Committee").otherwise(F.col("name"))
    return D.without_artefacts(t.committee().withColumn("name", name)).select("doc_id", "pos", "name")


@R.query("""
SELECT coalesce(b.hash, a.hash) AS hash, coalesce(b.text, a.text) AS text, coalesce(b.year, a.year) AS year FROM
 (SELECT p_name AS hash, min(p_brand) AS text, min(p_size) AS year FROM part GROUP BY 1) a FULL OUTER JOIN
 (SELECT p_name AS hash, max(p_type) AS text, CASE WHEN max(p_size) > 45 THEN max(p_size) END AS year FROM part WHERE p_size > 25 GROUP BY 1) b ON a.hash = b.hash""")
def citations_merged(t: Tables) -> DataFrame:
    part = t.raw("part")
    old = part.groupBy(F.col("p_name").alias("hash")).agg(F.min("p_brand").alias("text"), F.min("p_size").alias("year"))
    most = F.max("p_size")
    new = part.filter("p_size > 25").groupBy(F.col("p_name").alias("hash")).agg(F.max("p_type").alias("text"), F.when(most > 45, most).alias("year"))
    return D.merged_citations(old, new)


@R.query("SELECT l_orderkey AS doc_id, l_partkey AS citation_id, strftime(max(l_shipdate), '%Y-%m-%d') AS updated_at FROM lineitem GROUP BY 1, 2")
def links_touched(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("citation_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("updated_at"))
    return D.touched_links(rows)


@R.query("""
SELECT coalesce(b.citation_id, a.citation_id) AS citation_id, CASE WHEN b.citation_id IS NOT NULL THEN b.hits ELSE a.hits END AS hits, CASE WHEN b.citation_id IS NOT NULL THEN b.bib_id ELSE a.bib_id END AS bib_id
FROM lookups a FULL OUTER JOIN (SELECT s_suppkey AS citation_id, CASE WHEN s_acctbal > 0 THEN 5 END::BIGINT AS hits, NULL::VARCHAR AS bib_id FROM supplier WHERE s_acctbal < 5000) b ON a.citation_id = b.citation_id""")
def lookups_overwritten(t: Tables) -> DataFrame:
    """New lookups replace old ones, missing values too."""
    balance = F.col("s_acctbal")
    new = t.raw("supplier").filter(balance < 5000).select(F.col("s_suppkey").alias("citation_id"), F.when(balance > 0, 5).cast("long").alias("hits"), F.lit(None).cast("string").alias("bib_id"))
    return upsert(t.lookups().select("citation_id", "hits", "bib_id"), new, "citation_id")


@R.query("""
SELECT id, name, min(created_at) OVER (PARTITION BY id) AS created_at FROM (
 SELECT c_custkey AS id, c_name AS name, c_mktsegment AS created_at, 0 AS fresh FROM customer WHERE c_mktsegment < 'H' UNION ALL
 SELECT c_custkey, upper(c_name), concat('A', c_mktsegment), 1 FROM customer WHERE c_mktsegment > 'C')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY fresh DESC) = 1""")
def import_rules_merged(t: Tables) -> DataFrame:
    """Rules keep the time of their creation when they are stored again; segments stand for times."""
    rows, at = t.raw("customer"), F.col("c_mktsegment")
    old = rows.filter(at < "H").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), at.alias("created_at"))
    new = rows.filter(at > "C").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.concat(F.lit("A"), at).alias("created_at"))
    return D.merged_rules(old, new)


# Records.


@R.query("""SELECT page_id, list_distinct(list_concat([trim(url)], regexp_extract_all(html, '(?i)https?://[^\\s"''<>]+'))) AS u FROM pages""".replace("SELECT page_id, ", "SELECT page_id, len(u)::INTEGER AS n, array_to_string(list_sort(u), ' ') AS urls FROM (SELECT page_id, ", 1) + ")")
def candidate_urls(t: Tables) -> DataFrame:
    """The addresses that a page's fields hold."""
    rows = t.raw("pages").select("page_id", D.addresses(F.array("url", F.concat(F.lit("page: "), "html"))).alias("u"))
    return rows.select("page_id", F.size("u").alias("n"), F.array_join(F.array_sort("u"), " ").alias("urls"))


@R.query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'title,ID,' || p_brand || ',identifier,uri,digitalResourceOriginalRecord' ELSE 'uri,creator,id,identifier,digitalResourceOriginalRecord' END AS fields FROM part")
def source_field_lists(t: Tables) -> DataFrame:
    asked = F.when(F.col("p_size") > 25, F.concat(F.lit("title, ID,"), "p_brand")).otherwise("uri,,creator ")
    return t.raw("part").select(F.col("p_partkey").alias("id"), D.source_fields(asked).alias("fields"))


@R.query("SELECT doc_id, CASE WHEN source = 'src3' THEN source ELSE '(Unspecified)' END AS subjects, 0 AS themes, CASE WHEN lang = 'en' THEN n_chars ELSE length(coalesce(text, '')) END::BIGINT AS char_count FROM documents")
def records_repaired(t: Tables) -> DataFrame:
    rows = t.raw("documents").select(
        "doc_id",
        F.col("text").alias("abstract"),
        F.when(F.col("source") == "src3", F.array("source")).alias("subjects"),
        F.lit(None).cast("array<string>").alias("themes"),
        F.when(F.col("lang") == "en", F.col("n_chars")).cast("long").alias("char_count"),
    )
    return D.repaired(rows, ("themes",)).select("doc_id", F.array_join("subjects", "|").alias("subjects"), F.size("themes").alias("themes"), "char_count")


@R.query("SELECT o_orderkey AS doc_id, upper(o_orderpriority) AS title, coalesce(nullif(page_count, 0), 7) AS page_count, coalesce(nullif(body_word_count, 0), 9) AS body_word_count FROM orders LEFT JOIN metrics ON doc_id = o_orderkey")
def metadata_healed(t: Tables) -> DataFrame:
    """Records made anew from their source keep the metrics that are stored."""
    fresh = t.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.upper("o_orderpriority").alias("title"), F.lit(7).cast("long").alias("page_count"), F.lit(9).cast("long").alias("body_word_count"))
    return D.healed(t.metrics(), fresh, "doc_id", ("page_count", "body_word_count"))


@R.query("SELECT DISTINCT term, concat('c:', regexp_replace(term, '\\s+', '_', 'g')) AS id FROM terms")
def concept_ids(t: Tables) -> DataFrame:
    return t.terms().select("term", D.concept_id(F.col("term")).alias("id")).distinct()


@R.query("""SELECT DISTINCT degree, concat('{"baseUrl":"http://x","requestedIndex":"', affiliation, '","query":"","term":"', degree, '","source":"title,id,identifier,uri,digitalResourceOriginalRecord"}') AS key FROM docs""")
def sync_keys(t: Tables) -> DataFrame:
    rows = t.docs().select("degree", "affiliation").distinct()
    none = F.lit(None).cast("string")
    return rows.select("degree", D.sync_key(F.lit("http://x"), F.col("affiliation"), none, F.col("degree"), F.lit("title")).alias("key"))


@R.query("""
SELECT d.doc_id, members, supervisors, source FROM docs d LEFT JOIN (
 SELECT doc_id, count(*) AS members, string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (WHERE role IN ('Supervisor', 'Co-Supervisor')) AS supervisors,
 CASE WHEN bool_or(source = 'api') FILTER (WHERE role IN ('Supervisor', 'Co-Supervisor')) THEN 'api' WHEN count(*) FILTER (WHERE role IN ('Supervisor', 'Co-Supervisor')) > 0 THEN 'pdf_fallback' END AS source
 FROM committee GROUP BY doc_id) c USING (doc_id)""")
def documents_with_committee(t: Tables) -> DataFrame:
    both = D.with_committee(t.docs().select("doc_id"), t.committee())
    names = F.nullif(F.array_join(F.array_sort("supervisors"), ", "), F.lit(""))
    return both.select("doc_id", F.size("members").cast("long").alias("members"), names.alias("supervisors"), F.col("supervisors_source").alias("source")).withColumn("members", F.when(F.col("members") >= 0, F.col("members")))


@R.query("""
SELECT requested, coalesce(CASE WHEN regexp_matches(requested, '^[0-9]+$') THEN requested END, r_regionkey::VARCHAR, requested) AS index FROM (
 SELECT CASE WHEN n_nationkey < 8 THEN n_nationkey::VARCHAR WHEN n_nationkey < 16 THEN (SELECT lower(r_name) FROM region WHERE r_regionkey = n_regionkey) ELSE n_name END AS requested FROM nation) LEFT JOIN region ON lower(r_name) = lower(requested)""")
def index_names(t: Tables) -> DataFrame:
    """Collections asked for by number, by name, and by a name that none has."""
    nation, region = t.raw("nation"), t.raw("region")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    asked = F.when(F.col("n_nationkey") < 8, F.col("n_nationkey").cast("string")).when(F.col("n_nationkey") < 16, F.lower("r_name")).otherwise(F.col("n_name"))
    return D.resolved_index(both.select(asked.alias("requested")), region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("index")))


@R.query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_size ELSE nullif(p_size % 4, 0) END::BIGINT AS pages FROM part")
def pdf_page_counts(t: Tables) -> DataFrame:
    """Pages that a description names, or else page objects in the bytes, beside one object that holds them."""
    size = F.col("p_size")
    content = F.encode(F.concat(F.lit("/Type /Pages "), F.repeat(F.lit("x /Type/Page\n"), (size % 4).cast("int"))), "ISO-8859-1")
    info = F.when(size > 40, F.concat(F.lit("Title: x\nPages:   "), size.cast("string"), F.lit("\nEncrypted: no")))
    return t.raw("part").select(F.col("p_partkey").alias("id"), D.pdf_pages(content, info).alias("pages"))


@R.query("""
SELECT doc_id, CASE WHEN status = 'cached' THEN 'cached' WHEN word_source = 'downloaded_pdf_text' THEN 'cached_full_text' WHEN page_count > 50 THEN 'downloaded' WHEN body_word_count > 50000 THEN 'error' ELSE 'not_found' END AS status FROM metrics""")
def file_statuses(t: Tables) -> DataFrame:
    url = F.when(F.col("body_word_count") > 50000, "http://x").otherwise("")
    status = D.file_status(F.col("status") == "cached", F.coalesce(F.col("word_source") == "downloaded_pdf_text", F.lit(False)), url, F.col("page_count") > 50)
    return t.metrics().select("doc_id", status.alias("status"))


FILES = """(SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey AS id, CASE WHEN l_quantity > 30 THEN 'Scan.PDF' WHEN l_quantity > 20 THEN 'scan.Pdf.txt' ELSE 'scan.jpg' END AS name,
 CASE l_returnflag WHEN 'A' THEN 'application/PDF' WHEN 'N' THEN CASE WHEN l_quantity > 40 THEN 'Text/plain; charset=utf-8' ELSE 'image/png' END END AS mime,
 CASE WHEN l_linestatus = 'F' THEN 'original' WHEN l_quantity < 5 THEN 'text' ELSE 'other' END AS bundle FROM lineitem)"""


@R.query(f"""
SELECT doc_id, first(id ORDER BY pos, id, name) FILTER (is_text) AS text_id, first(name ORDER BY pos, id, name) FILTER (is_text) AS text_name, first(id ORDER BY pos, id, name) FILTER (is_pdf) AS pdf_id, first(name ORDER BY pos, id, name) FILTER (is_pdf) AS pdf_name FROM (
 SELECT *, coalesce(mime LIKE 'Text/plain%', false) OR bundle = 'text' OR name = 'scan.Pdf.txt' AS is_text, coalesce(mime LIKE '%PDF%', false) AND (bundle = 'original' OR name = 'Scan.PDF') AS is_pdf FROM {FILES}) GROUP BY doc_id""")
def files_chosen(t: Tables) -> DataFrame:
    """The text and the PDF to take of each document's files; quantities and flags stand for names, types and bundles."""
    q = F.col("l_quantity")
    name = F.when(q > 30, "Scan.PDF").when(q > 20, "scan.Pdf.txt").otherwise("scan.jpg")
    mime = F.when(F.col("l_returnflag") == "A", "application/PDF").when(F.col("l_returnflag") == "N", F.when(q > 40, "Text/plain; charset=utf-8").otherwise("image/png"))
    bundle = F.when(F.col("l_linestatus") == "F", "original").when(q < 5, "text").otherwise("other")
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"), name.alias("name"), mime.alias("mime"), bundle.alias("bundle"))
    return K.chosen_files(rows)


@R.query("""
SELECT doc_id, sha1(doc_id::VARCHAR) || '.txt' AS path, strlen(CASE WHEN hit THEN text ELSE text || text END)::BIGINT AS bytes, CASE WHEN hit THEN NULL ELSE 'http://x/' || doc_id END AS source_url, hit AS cache_hit FROM (
 SELECT doc_id, text, source, coalesce(lang = 'en' AND length(text) > 1000, false) AS hit FROM documents) WHERE hit OR (source <> 'src0' AND length(text) * 2 > 1000)""")
def full_text_sources(t: Tables) -> DataFrame:
    """Texts of one language are cached; those of all sources but one can be fetched, twice as long."""
    docs = t.raw("documents")
    cached = docs.filter("lang = 'en'").select("doc_id", "text", F.lit(None).cast("string").alias("source_url"))
    fetched = docs.filter("source <> 'src0'").select("doc_id", F.concat("text", "text").alias("text"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("source_url"))
    return K.full_texts(cached, fetched).drop("full_text")


@R.query("""
SELECT page_id AS doc_id, sha1(coalesce(nullif(CASE WHEN page_id > 20 THEN url ELSE '' END, ''), page_id::VARCHAR)) || '.pdf' AS path, strlen(html)::BIGINT AS bytes FROM pages
WHERE strlen(html) BETWEEN 1 AND 3000 AND (contains(url, '/fr/') OR page_id < 50)""")
def pdfs_kept(t: Tables) -> DataFrame:
    """Fetched files that are of the type, not empty and not over the limit; addresses stand for types."""
    kind = F.when(F.contains("url", F.lit("/fr/")), "application/PDF;x").otherwise("text/html")
    rows = t.raw("pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") > 20, F.col("url")).otherwise("").alias("url"), F.encode("html", "UTF-8").alias("content"), kind.alias("content_type"), F.when(F.col("page_id") < 50, "a.PDF").alias("name"))
    return K.kept_pdfs(rows, 3000).select("doc_id", "path", "bytes")


# What is shown.

PERSONS = """(SELECT lower(replace(name, '#', ' ')) AS key, replace(name, '#', ' ') AS name, string_agg(DISTINCT coalesce(role, 'Committee Member'), '; ' ORDER BY coalesce(role, 'Committee Member')) AS roles,
 string_agg(DISTINCT c.affiliation, '; ' ORDER BY c.affiliation) AS affiliations, count(DISTINCT doc_id) AS doc_count, min(year) AS first_year, max(year) AS last_year
 FROM committee c JOIN docs d USING (doc_id) GROUP BY name)"""


@R.query(f"SELECT key, name, doc_count, CASE WHEN first_year = last_year THEN first_year::VARCHAR ELSE concat(first_year, '–', last_year) END AS years FROM {PERSONS} WHERE list_contains(string_split(roles, '; '), 'Supervisor') AND contains(lower(concat_ws(' ', name, roles, affiliations)), 'nation_1') ORDER BY doc_count DESC, lower(name), name")
def people_found(t: Tables) -> DataFrame:
    """People of a role with a text in their name, roles or affiliations, those with most documents first."""
    found = D.people_sorted(D.people_filter(P.person_list(dotted(t), t.docs()), "Supervisor", "nation_1"), "documents")
    return found.select("key", "name", "doc_count", P.year_range(F.col("first_year"), F.col("last_year")).alias("years"))


@R.query("SELECT doc_id, title, author FROM docs WHERE contains(lower(concat_ws(' ', doc_id::VARCHAR, title, author)), 'building') ORDER BY doc_id LIMIT 200")
def cache_entries_found(t: Tables) -> DataFrame:
    """The first 200 entries that hold a text."""
    rows = t.docs().select("doc_id", "title", "author")
    return D.table_filter(rows, [F.col("doc_id").cast("string"), F.col("title"), F.col("author")], "building").orderBy("doc_id").limit(200)


@R.query("SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(DISTINCT topic_id) AS topics FROM doc_topics WHERE x IS NOT NULL AND y IS NOT NULL AND topic_id IS NOT NULL")
def plot_domain(t: Tables) -> DataFrame:
    rows = D.plottable(t.doc_topics())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.countDistinct("topic_id").alias("topics"))


@R.query(f"SELECT count(DISTINCT lower(name)) AS supervisors FROM {SUPERVISORS}")
def supervisor_count(t: Tables) -> DataFrame:
    return supervisors(t).agg(F.countDistinct(F.lower("name")).alias("supervisors"))


OWN = f"(SELECT DISTINCT doc_id FROM {SUPERVISORS} WHERE name = 'Supplier#000000007')"


@R.query(f"""
SELECT 'Supplier#000000007' AS name, (SELECT count(*) FROM {OWN} JOIN docs USING (doc_id)) AS doc_count,
 (SELECT CASE WHEN min(year) = max(year) THEN min(year)::VARCHAR ELSE concat(min(year), '–', max(year)) END FROM {OWN} JOIN docs USING (doc_id)) AS years,
 (SELECT string_agg(concat(term, ':', n), '; ' ORDER BY n DESC, term) FROM (SELECT term, count(*) AS n FROM terms WHERE doc_id IN (SELECT doc_id FROM {OWN}) GROUP BY 1 ORDER BY n DESC, term LIMIT 12)) AS terms,
 (SELECT string_agg(concat(method, ':', n), '; ' ORDER BY n DESC, method) FROM (SELECT method, count(*) AS n FROM methods WHERE doc_id IN (SELECT doc_id FROM {OWN}) GROUP BY 1)) AS methods""")
def supervisor_profile(t: Tables) -> DataFrame:
    return P.profile(supervisors(t), t.docs(), t.terms(), t.methods(), "Supplier#000000007")


@R.query("""
SELECT x.topic_id, CASE WHEN x.topic_id = -1 THEN 'Uncategorized' ELSE regexp_replace(replace(label, '_', ' '), '^-?[0-9]+ ', '') END AS label, n FROM (
 SELECT topic_id, count(*) AS n FROM doc_topics JOIN docs USING (doc_id) WHERE affiliation = 'NATION_3' GROUP BY 1) x JOIN topics t ON t.topic_id = x.topic_id""")
def topic_summary(t: Tables) -> DataFrame:
    """Topics of one country's documents."""
    own = t.doc_topics().join(t.docs().filter("affiliation = 'NATION_3'").select("doc_id"), "doc_id", "left_semi")
    return O.summary(own, t.topics())


@R.query("""
SELECT doc_id, format('{:,}', word_count) AS words, CASE WHEN body_word_count IS NULL THEN '-' WHEN page_count = 0 THEN '-' WHEN page_count * 60 < 1024 THEN concat(page_count * 60, ' B')
 WHEN page_count * 60 < 1048576 THEN concat(printf('%.1f', floor(page_count * 60 / 1024.0::DOUBLE * 10 + 0.5) / 10), ' KB') ELSE 'MB' END AS size FROM metrics WHERE word_count IS NOT NULL""")
def formatted_metrics(t: Tables) -> DataFrame:
    rows = t.metrics().filter("word_count is not null")
    size = F.when(F.col("body_word_count").isNotNull(), F.col("page_count") * 60)
    return rows.select("doc_id", D.formatted_number(F.col("word_count")).alias("words"), D.formatted_bytes(size).alias("size"))


# Citations and exports.

DATED = "(SELECT id, concat_ws(' ', text, (1950 + year::INTEGER)::VARCHAR) AS text FROM citations)"


def dated(t: Tables) -> DataFrame:
    return t.citations().select("id", F.concat_ws(" ", "text", (F.lit(1950) + F.col("year").cast("int")).cast("string")).alias("text"))


@R.query("SELECT id, year::INTEGER > 40 OR year::INTEGER < 5 OR length(text) < 25 AS junk FROM citations")
def junk_citations(t: Tables) -> DataFrame:
    """Some are notes on where they were found and some only a publisher; of the others those that are short are junk."""
    size = F.col("year").cast("int")
    text = F.when(size > 45, F.concat(F.lit("Retrieved from "), "text")).when(size > 40, F.concat(F.lit(" HTTP://x.org/"), "text")).when(size < 5, "Philadelphia, PA: Lippincott").otherwise(F.col("text"))
    return t.citations().select("id", junk_citation(text).alias("junk"))


@R.query(f"SELECT id, concat(trim(regexp_extract(text, '^([^,.(]+)', 1)), ', ', regexp_extract(text, '\\b((?:19|20)\\d{{2}})\\b', 1)) AS label FROM {DATED}")
def short_labels(t: Tables) -> DataFrame:
    return dated(t).select("id", C.short_label(F.col("text")).alias("label"))


@R.query(f"""SELECT id, left(trim(regexp_replace('"' || text || '\\\\' || chr(9) || 'x"', '["\\\\\\s]+', ' ', 'g')), 240) AS value FROM {DATED}""")
def catalogue_query_values(t: Tables) -> DataFrame:
    return dated(t).select("id", C.pqf_value(F.concat(F.lit('"'), "text", F.lit('\\\tx"'))).alias("value"))


@R.query("SELECT o_orderkey AS doc_id, concat('@phdthesis{', left(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 20), year(o_orderdate), ',', chr(10), '  title = {', o_orderpriority, '},', chr(10), '  author = {', c_name, '},', chr(10), '  year = {', year(o_orderdate), '}', chr(10), '}') AS entry FROM orders JOIN customer ON o_custkey = c_custkey")
def export_bibtex(t: Tables) -> DataFrame:
    return t.docs().select("doc_id", C.bibtex(F.col("degree"), F.col("author"), F.col("year")).alias("entry"))


@R.query("SELECT p_partkey AS id, concat(p_brand, ', ', p_type, '; Second, A. (', p_size, '). ', p_name, '. Journal of ', p_type, '. ', p_size, CASE WHEN p_size > 25 THEN '(2)' ELSE '' END, '. 1-', p_size) AS text FROM part")
def csl_citations(t: Tables) -> DataFrame:
    """References in CSL form as one line."""
    size = F.col("p_size").cast("string")
    first = F.struct(F.col("p_brand").alias("family"), F.col("p_type").alias("given"))
    other = F.struct(F.lit("Second").alias("family"), F.lit("A").alias("given"))
    csl = F.struct(F.array(first, other).alias("author"), size.alias("year"), F.col("p_name").alias("title"), F.concat(F.lit("Journal of "), "p_type").alias("container"), size.alias("volume"), F.when(F.col("p_size") > 25, "2").alias("issue"), F.concat(F.lit("1-"), size).alias("page"), F.lit("").alias("publisher"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.csl_text(csl).alias("text"))


@R.query("""
SELECT p_partkey AS id, p_brand || ', ' || p_type || '; Second, A. (' || (1900 + p_size) || '). ' || p_name || ' & more. Journal of ' || p_type || '. ' || p_size || CASE WHEN p_size > 25 THEN '(2)' ELSE '' END || '. 1-' || p_size AS text,
 p_brand || ', ' || p_type || '; Second, A' AS author, p_name || ' & more' AS title, (1900 + p_size)::VARCHAR AS year, 'Journal of ' || p_type AS source FROM part
UNION ALL SELECT p_partkey, '(' || (1900 + p_size) || '). Handbook of ' || p_type || '. ' || p_brand || ' Press', NULL, 'Handbook of ' || p_type, (1900 + p_size)::VARCHAR, NULL FROM part
UNION ALL SELECT p_partkey, 'As printed: ' || p_name || ' by ' || p_brand, NULL, NULL, NULL, NULL FROM part""")
def tei_references(t: Tables) -> DataFrame:
    """An article by two, a book, one as printed only, one that is too short and one that is junk, for each part."""
    p = t.raw("part").select("p_partkey", "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("n"), (F.lit(1900) + F.col("p_size")).cast("string").alias("y"), (F.col("p_size") > 25).alias("late"))
    person = lambda given, family: F.concat(F.lit("<author><persName><forename type='first'>"), given, F.lit("</forename><forename type='middle'>M</forename><surname>"), family, F.lit("</surname></persName></author>"))
    issue = F.when(F.col("late"), "<biblScope unit='issue'>2</biblScope>").otherwise("")
    article = F.concat(F.lit("<TEI xmlns='http://www.tei-c.org/ns/1.0'><listBibl><biblStruct xml:id='b0'><analytic><title level='a' type='main'>"), "p_name", F.lit(" &amp; more</title>"), person(F.col("p_type"), F.col("p_brand")), person(F.lit("A"), F.lit("Second")), F.lit("</analytic><monogr><title level='j'>Journal of "), "p_type", F.lit("</title><imprint><biblScope unit='volume'>"), "n", F.lit("</biblScope>"), issue, F.lit("<biblScope unit='page' from='1' to='"), "n", F.lit("'/><date type='published' when='"), "y", F.lit("-05'/></imprint></monogr></biblStruct>"))
    book = F.concat(F.lit("<biblStruct><monogr><title level='m'>Handbook of "), "p_type", F.lit("</title><imprint><publisher>"), "p_brand", F.lit(" Press</publisher><date>in "), "y", F.lit("</date></imprint></monogr></biblStruct>"))
    printed = F.concat(F.lit("<biblStruct><note type='raw_reference'>As printed: "), "p_name", F.lit(" by "), "p_brand", F.lit("</note></biblStruct>"))
    rest = F.lit("<biblStruct><monogr><title level='m'>Short</title></monogr></biblStruct><biblStruct><monogr><title level='m'>Retrieved from a place that is gone</title></monogr></biblStruct></listBibl></TEI>")
    return X.tei_references(p.select(F.col("p_partkey").alias("id"), F.concat(article, book, printed, rest).alias("xml")), "xml")


@R.query("SELECT p_partkey AS id, lower(regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9]+', ' ', 'g')) AS text FROM part")
def canonical_texts(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("id"), canonicalise(F.concat_ws("-_ ", "p_name", "p_type")).alias("text"))


HIT = "CASE c_custkey % 4 WHEN 3 THEN c_name || ':' || c_mktsegment ELSE '1.' || c_custkey END"


@R.query(f"""
SELECT {HIT} AS doc_id, c_name AS title, [c_mktsegment, 'Other, A.'] AS authors, c_mktsegment AS author, ['Ann Lee'] AS supervisors, 'api' AS supervisors_source, [n_name] AS affiliation,
 'c' || (1990 + c_nationkey) AS date, 1990 + c_nationkey AS year, 'Master; Doctor' AS degree, n_name AS program, 'Thesis' AS type, '' AS rights, CASE c_custkey % 4 WHEN 2 THEN 'https://x.org/pdf/7/1.' || c_custkey || '?a=1' ELSE '' END AS doi,
 'North' AS campus, 'Graduate' AS scholarly_level, CASE WHEN c_nationkey > 12 THEN 'no number; ' || (c_nationkey + 1) || ' leaves' ELSE 'no number' END AS extent, CASE WHEN c_nationkey > 12 THEN c_nationkey + 1 ELSE 2 END AS page_count,
 CASE WHEN c_nationkey > 12 THEN 'metadata_extent' ELSE 'estimated_from_metadata_words' END AS page_source, 'A survey of ' || lower(c_mktsegment) AS abstract, CASE WHEN c_nationkey > 5 THEN [n_name, 'two'] ELSE ['(Unspecified)'] END AS subjects,
 600::BIGINT AS word_count, 'metadata_text' AS word_source, 2999::BIGINT AS char_count, []::VARCHAR[] AS themes, ['Survey'] AS methodologies, []::VARCHAR[] AS concept_terms,
 CASE c_custkey % 4 WHEN 1 THEN 'https://x.org/items/1.' || c_custkey || '#top' WHEN 0 THEN '1.' || c_custkey ELSE 'x7' END AS uri, '' AS original_record_url,
 CASE c_custkey % 4 WHEN 1 THEN ['https://x.org/items/1.' || c_custkey || '#top'] WHEN 2 THEN ['https://x.org/pdf/7/1.' || c_custkey || '?a=1'] ELSE [] END AS download_candidates,
 NULL::VARCHAR AS download_url, 'not_attempted' AS download_status, NULL::VARCHAR AS download_error, NULL::BIGINT AS file_bytes, NULL::BIGINT AS body_word_count
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def hit_records(t: Tables) -> DataFrame:
    """All fields of search hits, each page of hits one JSON payload; ids stand in the record, its address, a file's address or nowhere."""
    rows = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind, late = F.col("c_custkey") % 4, F.col("c_nationkey")
    named = F.concat(F.lit("1."), F.col("c_custkey").cast("string"))
    source = F.struct(
        F.when(kind == 0, named).otherwise("x7").alias("identifier"),
        F.array(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("title"),
        F.array(F.array("c_mktsegment", F.lit("")), F.array(F.lit("Other, A. "))).alias("creator"),
        F.lit("").alias("supervisor"),
        F.array(F.lit("Dr. Ann Lee"), F.lit("Lee, Ann")).alias("Supervisor"),
        F.concat(F.lit("c"), (F.lit(1990) + late).cast("string")).alias("dateIssued"),
        F.array("n_name", F.lit("")).alias("Affiliation"),
        F.array(F.lit("Master"), F.lit("Doctor")).alias("degree_theses"),
        F.col("n_name").alias("Program"),
        F.lit("Thesis").alias("genre"),
        F.lit("North").alias("campus"),
        F.lit("Graduate").alias("ScholarlyLevel"),
        F.concat(F.lit("A survey of "), F.lower("c_mktsegment")).alias("description"),
        F.repeat(F.lit("word \n"), F.lit(600)).alias("transcript"),
        F.when(late > 5, F.array("n_name", F.lit("two"))).alias("keywords"),
        F.when(late > 12, F.array(F.lit("no number"), F.concat((late + 1).cast("string"), F.lit(" leaves")))).otherwise(F.array(F.lit("no number"))).alias("extent"),
        F.when(kind == 1, F.concat(F.lit("https://x.org/items/"), named, F.lit("#top"))).otherwise("").alias("uri"),
        F.when(kind == 2, F.concat(F.lit("https://x.org/pdf/7/"), named, F.lit("?a=1"))).alias("doi"),
        F.lit(0).alias("rights"),
    )
    paged = rows.groupBy((F.col("c_custkey") / 100).cast("long").alias("page")).agg(F.collect_list(F.struct(F.lit("h").alias("_id"), source.alias("_source"))).alias("hits"))
    payload = F.to_json(F.struct(F.struct(F.struct("hits").alias("hits")).alias("data")))
    return S.records(S.hits(paged.select(payload.alias("payload"))))


# Topics.

USES = f"(SELECT doc_id, term, tf AS n, topic_id FROM {TF} JOIN doc_topics USING (doc_id))"
CLASSES = f"""uses AS MATERIALIZED {USES}, byc AS MATERIALIZED (SELECT topic_id, term, sum(n) AS n FROM uses GROUP BY 1, 2), sizes AS (SELECT topic_id, sum(n) AS size FROM byc GROUP BY 1),
every AS (SELECT term, sum(n) AS every FROM byc GROUP BY 1), w AS MATERIALIZED (SELECT topic_id, term, n / size * ln(1 + (SELECT avg(size) FROM sizes) / every) AS weight FROM byc JOIN sizes USING (topic_id) JOIN every USING (term))"""


def uses(t: Tables) -> DataFrame:
    """doc_id, term, n of the texts."""
    return t.raw("documents").select("doc_id", F.inline(H.token_counts(F.col("text")))).withColumnRenamed("tf", "n")


def terms_by_topic(t: Tables) -> DataFrame:
    placed = uses(t).join(t.doc_topics().select("doc_id", "topic_id"), "doc_id")
    return placed.groupBy("topic_id", "term").agg(F.sum("n").alias("n"))


@R.query(f"WITH {CLASSES} SELECT topic_id, rank, term, weight FROM (SELECT topic_id, term, round(weight, 9) AS weight, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, term)::INTEGER AS rank FROM w) WHERE rank <= 10")
def topic_terms(t: Tables) -> DataFrame:
    """The terms of most class-wise TF-IDF of each topic."""
    return O.topic_terms(O.class_weights(terms_by_topic(t)))


@R.query(f"""
WITH {CLASSES}, own AS (SELECT doc_id, term, n / sum(n) OVER (PARTITION BY doc_id) * ln(1 + (SELECT avg(size) FROM sizes) / every) AS own FROM uses JOIN every USING (term) WHERE topic_id = -1),
near AS (SELECT doc_id, w.topic_id, round(sum(own * weight) / (any_value(norm) * any_value(length)), 9) AS cosine FROM own JOIN w USING (term) JOIN (SELECT topic_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY 1) x ON x.topic_id = w.topic_id
 JOIN (SELECT doc_id AS d, sqrt(sum(own * own)) AS length FROM own GROUP BY 1) ON d = doc_id WHERE w.topic_id <> -1 GROUP BY 1, 2),
best AS (SELECT doc_id, topic_id AS moved FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic_id) AS r FROM near WHERE cosine >= 0.15) WHERE r = 1)
SELECT doc_id, coalesce(moved, topic_id) AS topic_id FROM (SELECT DISTINCT doc_id, topic_id FROM uses) LEFT JOIN best USING (doc_id)""")
def outliers_reassigned(t: Tables) -> DataFrame:
    """Topics of texts, outliers moved to the topic whose vocabulary they share."""
    some = t.raw("documents").filter(F.size(H.token_counts(F.col("text"))) > 0).select("doc_id").distinct()
    return O.reassigned(uses(t), cut(t.doc_topics().join(some, "doc_id", "left_semi").select("doc_id", "topic_id")))


LABELLED = "(SELECT doc_id AS id, doc_id // 10 AS topic_id, 60 + (doc_id * 7) % 41 AS score, doc_id AS created, CASE WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status, quality = 0 AS warned FROM labels)"


def labelled(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.raw("labels").select(d.alias("id"), F.expr("doc_id div 10").alias("topic_id"), (60 + d * 7 % 41).alias("score"), d.alias("created"), F.when(d % 5 == 0, "rejected").otherwise("pending").alias("status"), (F.col("quality") == 0).alias("warned"))


@R.query(f"""
WITH c AS {LABELLED}, b AS (SELECT topic_id, id AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, created DESC, id DESC) AS r FROM c WHERE status <> 'rejected' AND score >= 80 AND NOT warned AND topic_id <> 3) WHERE r = 1)
SELECT id, c.topic_id, CASE WHEN chosen IS NULL THEN status WHEN id = chosen THEN 'auto_selected' ELSE 'rejected' END AS status FROM c LEFT JOIN b USING (topic_id)""")
def labels_published(t: Tables) -> DataFrame:
    """States of label candidates after all passing ones are published; one topic has a label chosen by hand."""
    rows = labelled(t)
    return O.published(rows, rows.filter("topic_id = 3").select("topic_id").distinct()).select("id", "topic_id", "status")


@R.query(f"SELECT id, topic_id, CASE WHEN topic_id = 4 AND (SELECT count(*) FROM {LABELLED} WHERE id = 42 AND topic_id = 4) > 0 THEN CASE WHEN id = 42 THEN 'selected' ELSE 'rejected' END ELSE status END AS status FROM {LABELLED}")
def label_selected(t: Tables) -> DataFrame:
    return O.selected(labelled(t), 4, 42).select("id", "topic_id", "status")


@R.query(f"""
WITH c AS {LABELLED}, given AS (SELECT topic_id, max(created) AS id FROM c WHERE topic_id >= 2 GROUP BY topic_id)
SELECT topic_id, CASE WHEN topic_id < 2 THEN 'old' WHEN topic_id % 2 = 0 THEN 'label ' || id ELSE 'own ' || topic_id END AS label, CASE WHEN topic_id < 2 THEN 'selected' WHEN topic_id % 2 = 0 THEN 'selected' ELSE 'manual' END AS source,
 CASE WHEN topic_id < 2 THEN 7 WHEN topic_id % 2 = 0 THEN id END AS candidate_id, CASE WHEN topic_id < 5 THEN '2023' ELSE '2024' END AS created_at, CASE WHEN topic_id < 2 THEN '2023' ELSE '2024' END AS updated_at
FROM (SELECT DISTINCT topic_id FROM c) LEFT JOIN given USING (topic_id) WHERE topic_id <> 6""")
def labels_overridden(t: Tables) -> DataFrame:
    """Labels set by hand: texts of one's own and candidates; a blank one and one for no topic change nothing; one is unlocked again."""
    rows = labelled(t)
    topics = rows.select("topic_id").distinct()
    n = F.col("topic_id")
    old = topics.filter("topic_id < 5").select(n, F.lit("old").alias("label"), F.lit("selected").alias("source"), F.lit(7).cast("long").alias("candidate_id"), F.lit("2023").alias("created_at"), F.lit("2023").alias("updated_at"))
    last = rows.groupBy("topic_id").agg(F.max("created").alias("id"))
    even = n % 2 == 0
    text = F.when(n < 2, "  ").when(even, F.concat(F.lit("label "), F.col("id").cast("string"))).otherwise(F.concat(F.lit(" own "), n.cast("string"), F.lit(" ")))
    given = last.select(n, text.alias("label"), F.when(even, F.col("id")).alias("candidate_id"))
    given = given.unionByName(given.select((-1 - n).alias("topic_id"), "label", "candidate_id"))
    return O.unlocked(O.overridden(old, topics, given, "2024"), topics.filter("topic_id = 6"))
