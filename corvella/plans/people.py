"""Queries over people, merges and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions.names import merged_names, person_name
from corvella.operators import documents as D
from corvella.operators import merge as M
from corvella.operators import people as P
from corvella.operators import topics as O
from corvella.operators import projection
from corvella.operators.density import clusters
from corvella.plans.registry import Registry
from corvella.plans.subjects import SUPERVISORS, supervisors
from corvella.sources.views import Tables

R = Registry()


def dotted(t: Tables) -> DataFrame:
    """The committee with names as they are found in print."""
    return t.committee().withColumn("name", F.concat(F.lit("Dr. "), F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" (UBC)")))


@R.query("SELECT DISTINCT name AS raw, lower(replace(name, '#', ' ')) AS key FROM committee")
def person_keys(t: Tables) -> DataFrame:
    names = t.committee().select("name").distinct()
    raw = F.concat(F.lit("Dr. "), F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" (UBC)"))
    return names.select(F.col("name").alias("raw"), P.ascii_key(person_name(raw)).alias("key"))


@R.query("""
SELECT lower(replace(name, '#', ' ')) AS key, replace(name, '#', ' ') AS name, string_agg(DISTINCT coalesce(role, 'Committee Member'), '; ' ORDER BY coalesce(role, 'Committee Member')) AS roles,
 string_agg(DISTINCT c.affiliation, '; ' ORDER BY c.affiliation) AS affiliations, count(DISTINCT doc_id) AS doc_count, min(year) AS first_year, max(year) AS last_year
FROM committee c JOIN docs d USING (doc_id) GROUP BY name""")
def person_list(t: Tables) -> DataFrame:
    return P.person_list(dotted(t), t.docs())


@R.query()
def person_dedupe(t: Tables) -> DataFrame:
    """Each document's people with name variants merged."""
    names = t.committee().groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return names.select("doc_id", merged_names("names").alias("names"))


@R.query(f"""
SELECT name, rank, term, n FROM (SELECT name, term, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, term)::INTEGER AS rank FROM (
 SELECT name, term, count(*) AS n FROM {SUPERVISORS} s JOIN terms USING (doc_id) GROUP BY 1, 2)) WHERE rank <= 12""")
def person_top_terms(t: Tables) -> DataFrame:
    return P.top_terms(supervisors(t), t.terms())


@R.query(f"SELECT name, count(*) AS n FROM {SUPERVISORS} s WHERE name <> 'Supplier#000000007' AND doc_id IN (SELECT doc_id FROM {SUPERVISORS} x WHERE name = 'Supplier#000000007') GROUP BY name")
def person_co_workers(t: Tables) -> DataFrame:
    return P.co_workers(supervisors(t), "Supplier#000000007")


@R.query("""
SELECT doc_id, role, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM (SELECT doc_id, name, coalesce(role, 'Committee Member') AS role FROM committee)
WHERE role NOT IN ('Supervisor', 'Co-Supervisor') GROUP BY 1, 2""")
def committee_by_role(t: Tables) -> DataFrame:
    return P.by_role(t.committee())


@R.query()
def affiliation_merged(t: Tables) -> DataFrame:
    rows = t.committee().select(F.col("name").alias("key"), F.concat_ws(" ", "affiliation", F.when(F.col("pos") > 2, "Faculty")).alias("affiliation"))
    return P.merged_affiliations(rows)


# The stored rows are documents up to a year, the incoming ones those from the year before it on; some new values are missing.
OLD = "(SELECT doc_id, title, year, sync_key FROM docs WHERE year <= 1995)"
NEW = "(SELECT doc_id, upper(title) AS title, year + 1 AS year, CASE WHEN degree <> '1-URGENT' THEN 'NEW' END AS sync_key FROM docs WHERE year >= 1994)"


def old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.docs()
    new = d.filter("year >= 1994").select("doc_id", F.upper("title").alias("title"), (F.col("year") + 1).alias("year"), F.when(F.col("degree") != "1-URGENT", "NEW").alias("sync_key"))
    return d.filter("year <= 1995").select("doc_id", "title", "year", "sync_key"), new


@R.query(f"SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.title ELSE a.title END AS title, CASE WHEN b.doc_id IS NOT NULL THEN b.year ELSE a.year END AS year, coalesce(b.sync_key, a.sync_key) AS sync_key FROM {OLD} a FULL OUTER JOIN {NEW} b ON a.doc_id = b.doc_id")
def document_upsert_coalesce(t: Tables) -> DataFrame:
    return M.upsert(*old_new(t), "doc_id", ("sync_key",))


for mode, where in (("import_all", "true"), ("sync_differences", "year > 1995"), ("refresh_metadata", "year <= 1995")):

    @R.query(f"SELECT doc_id, title FROM docs WHERE {where}", name=f"documents_by_sync_mode_{mode}")
    def sync_mode(t: Tables, mode: str = mode) -> DataFrame:
        """All documents come in; those up to a year are stored."""
        d = t.docs()
        return M.sync_rows(d, d.filter("year <= 1995"), "doc_id", mode).select("doc_id", "title")


@R.query("SELECT d.doc_id, title FROM docs d LEFT JOIN metrics m USING (doc_id) WHERE m.doc_id IS NULL OR status <> 'cached'")
def documents_missing_enrichment(t: Tables) -> DataFrame:
    """Documents without a stored file that needs no more work."""
    done = t.metrics().filter("status = 'cached'").select("doc_id")
    return t.docs().join(done, "doc_id", "left_anti").select("doc_id", "title")


@R.query("SELECT doc_id FROM metrics m WHERE status = 'cached' AND NOT EXISTS (SELECT 1 FROM committee c WHERE c.doc_id = m.doc_id AND role = 'External Examiner')")
def cached_without_committee(t: Tables) -> DataFrame:
    have = t.committee().filter("role = 'External Examiner'").select("doc_id").distinct()
    return t.metrics().filter("status = 'cached'").select("doc_id").join(have, "doc_id", "left_anti")


@R.query("""
WITH merged AS MATERIALIZED (SELECT doc_id, name, role, affiliation, source, 0 AS fresh FROM committee WHERE role IS DISTINCT FROM 'External Examiner'
 UNION ALL SELECT doc_id, name, role, 'NEW', 'pdf', 1 FROM committee WHERE role IS DISTINCT FROM 'Supervisor')
SELECT doc_id, name, role, affiliation, source FROM merged WHERE role IS NULL
UNION ALL SELECT doc_id, name, role, x.affiliation, x.source FROM (
 SELECT doc_id, name, role, arg_max({'affiliation': affiliation, 'source': source}, (CASE WHEN source = 'api' THEN 2 ELSE 0 END) + fresh) AS x FROM merged WHERE role IS NOT NULL GROUP BY 1, 2, 3)""")
def committee_upsert_precedence(t: Tables) -> DataFrame:
    """All but the external examiners are stored, all but the supervisors come in anew."""
    c = t.committee().select("doc_id", "name", "role", "affiliation", "source")
    new = c.filter(~F.col("role").eqNullSafe("Supervisor")).withColumn("affiliation", F.lit("NEW")).withColumn("source", F.lit("pdf"))
    return M.committee_upsert(c.filter(~F.col("role").eqNullSafe("External Examiner")), new)


@R.query("SELECT doc_id, name, role FROM committee WHERE NOT coalesce(doc_id = 7 AND role IN ('Supervisor', 'Co-Supervisor') AND source = 'pdf', false)")
def committee_delete_roles(t: Tables) -> DataFrame:
    return M.without_roles(t.committee(), 7, ("Supervisor", "Co-Supervisor"), "pdf").select("doc_id", "name", "role")


@R.query("SELECT id, text FROM citations WHERE id IN (SELECT citation_id FROM links JOIN docs USING (doc_id) WHERE year = 1996)")
def orphan_citation_cleanup(t: Tables) -> DataFrame:
    """What is left of the citations once the documents of all years but one are deleted with their links."""
    left = t.links().join(t.docs().filter("year = 1996").select("doc_id"), "doc_id")
    return M.without_orphans(t.citations(), left).select("id", "text")


@R.query("SELECT DISTINCT doc_id, canonical AS citation_id FROM links JOIN (SELECT id, min(id) OVER (PARTITION BY text) AS canonical FROM citations) ON id = citation_id")
def citation_relink_merge(t: Tables) -> DataFrame:
    """Links with citations of equal text made one."""
    same = t.citations().groupBy("text").agg(F.min("id").alias("canonical"))
    dup = t.citations().join(same, "text").filter("id <> canonical").select("id", "canonical")
    return M.relink(t.links(), dup)


@R.query("SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'done' ELSE program END AS program, CASE WHEN doc_id % 100 = 0 THEN 0 ELSE year END AS year FROM docs")
def partial_update(t: Tables) -> DataFrame:
    rows = t.docs().select("doc_id", "program", "year")
    return M.patch(rows, F.col("doc_id") % 100 == 0, {"program": F.lit("done"), "year": F.lit(0)})


# Topics.
BEST = "(SELECT topic_id FROM (SELECT topic_id, count(*) AS n FROM doc_topics WHERE topic_id <> -1 GROUP BY 1 ORDER BY n DESC, topic_id LIMIT 10))"
YEARLY = f"(SELECT topic_id, year, count(*) AS n FROM doc_topics JOIN docs USING (doc_id) WHERE topic_id IN {BEST} AND year IS NOT NULL GROUP BY 1, 2)"


@R.query(f"SELECT * FROM {YEARLY}")
def topics_by_year(t: Tables) -> DataFrame:
    return O.by_year(t.doc_topics(), t.docs())


@R.query(f"SELECT topic_id, ((SELECT min(year) FROM {YEARLY}) + ((year - (SELECT min(year) FROM {YEARLY})) // 5) * 5)::INTEGER AS period, sum(n)::BIGINT AS n FROM {YEARLY} GROUP BY 1, 2")
def topic_periods(t: Tables) -> DataFrame:
    return O.periods(O.by_year(t.doc_topics(), t.docs()))


@R.query("SELECT count(*) AS assigned, count(DISTINCT topic_id) AS topics, count(*) FILTER (WHERE topic_id = -1) AS outliers, max(probability) AS most FROM doc_topics")
def topic_build_status(t: Tables) -> DataFrame:
    return t.doc_topics().agg(F.count(F.lit(1)).alias("assigned"), F.countDistinct("topic_id").alias("topics"), F.count_if(F.col("topic_id") == -1).alias("outliers"), F.max("probability").alias("most"))


LONG = "(SELECT label, unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@R.query(f"SELECT label, dim, round(avg(x), 6) AS mean, count(*) AS n FROM {LONG} GROUP BY 1, 2")
def topic_centroids(t: Tables) -> DataFrame:
    return O.centroids(t.raw("embeddings"))


@R.query(f"""
WITH m AS (SELECT label, dim, avg(x) AS m FROM {LONG} GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS s FROM m GROUP BY 1)
SELECT a.label AS label_a, b.label AS label_b, round(sum(a.m * b.m) / (any_value(x.s) * any_value(y.s)), 6) AS cosine
FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label JOIN s x ON x.label = a.label JOIN s y ON y.label = b.label GROUP BY 1, 2""")
def topic_cosine_pairs(t: Tables) -> DataFrame:
    return O.cosine_pairs(t.raw("embeddings"))


@R.query()
def topic_parent_clusters(t: Tables) -> DataFrame:
    return O.parents(t.raw("embeddings"))


@R.query()
def topic_kmeans(t: Tables) -> DataFrame:
    return O.kmeans(t.raw("embeddings"))


def points(t: Tables) -> DataFrame:
    fine = t.raw("embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return fine.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@R.query()
def topic_density_clusters(t: Tables) -> DataFrame:
    """Clusters of any shape and outliers, by density."""
    return clusters(points(t)).withColumnRenamed("id", "vec_id")


@R.query()
def topic_plane(t: Tables) -> DataFrame:
    """Where each vector stands in a plane in which neighbours stay near."""
    return projection.plane(points(t)).withColumnRenamed("id", "vec_id")


@R.query()
def topic_pca_2d(t: Tables) -> DataFrame:
    return O.plane(t.raw("embeddings"))


CANDIDATES = """(SELECT doc_id % 12 AS topic_id, concat('label ', doc_id) AS label, 60 + doc_id % 41 AS score, doc_id AS created,
 quality = 0 AS warned FROM labels)"""


@R.query(f"SELECT topic_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, created DESC, label) AS n FROM {CANDIDATES} WHERE score >= 80 AND NOT warned) WHERE n = 1")
def best_label_per_topic(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.raw("labels").select((d % 12).alias("topic_id"), F.concat(F.lit("label "), d.cast("string")).alias("label"), (60 + d % 41).alias("score"), d.alias("created"), F.when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return O.best_label(rows)


TITLED = "(SELECT topic_id, concat(degree, ' ', program, ' ', year) AS title, probability FROM doc_topics JOIN docs USING (doc_id))"


@R.query(f"SELECT topic_id, rank, title FROM (SELECT topic_id, title, row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, title)::INTEGER AS rank FROM (SELECT topic_id, title, max(probability) AS p FROM {TITLED} GROUP BY 1, 2)) WHERE rank <= 5")
def first_titles_per_topic(t: Tables) -> DataFrame:
    rows = t.doc_topics().join(t.docs(), "doc_id").select("topic_id", F.concat_ws(" ", "degree", "program", F.col("year").cast("string")).alias("title"), "probability")
    return O.first_titles(rows)


@R.query("SELECT topic_id, rank, doc_id FROM (SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id)::INTEGER AS rank FROM doc_topics) WHERE rank <= 3")
def samples_per_topic(t: Tables) -> DataFrame:
    return O.samples(t.doc_topics())


@R.query("SELECT topic_id, label, doc_count, regexp_replace(replace(label, '_', ' '), '^-?[0-9]+ ', '') AS shown FROM topics ORDER BY topic_id = -1, doc_count DESC, topic_id")
def topic_order_outlier_last(t: Tables) -> DataFrame:
    return O.outlier_last(t.topics()).withColumn("shown", O.display_label(F.col("label")))


@R.query("""
SELECT label, count(*) AS topics, sum(doc_count)::BIGINT AS documents FROM (SELECT regexp_replace(label, '^-?[0-9]+_', '') AS label, doc_count FROM topics) GROUP BY 1 HAVING count(*) > 1""")
def label_duplicates(t: Tables) -> DataFrame:
    """Labels that several topics share."""
    rows = t.topics().withColumn("label", F.regexp_replace("label", "^-?[0-9]+_", ""))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("topics"), F.sum("doc_count").alias("documents")).filter("topics > 1")


@R.query("SELECT topic_id, count(*) AS candidates, count(*) FILTER (WHERE warned) AS warned, CASE WHEN count(*) FILTER (WHERE score >= 80 AND NOT warned) > 0 THEN 'ready' WHEN count(*) FILTER (WHERE warned) > 0 THEN 'warning' ELSE 'pending' END AS status FROM " + CANDIDATES + " GROUP BY topic_id")
def label_review_status(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.raw("labels").select((d % 12).alias("topic_id"), (60 + d % 41).alias("score"), (F.col("quality") == 0).alias("warned"))
    ready, warned = F.count_if((F.col("score") >= 80) & ~F.col("warned")), F.count_if("warned")
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("candidates"), warned.alias("warned"), F.when(ready > 0, "ready").when(warned > 0, "warning").otherwise("pending").alias("status"))
