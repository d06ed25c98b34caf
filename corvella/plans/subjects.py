"""Queries over terms, methods, people and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators import terms as T
from corvella.operators.bundle import TOPS, bundle, facts
from corvella.plans.corpus import ACTIVE, BOTH, WORDS_OK, both
from corvella.plans.registry import Registry
from corvella.sources.views import SUPERVISING, Tables

R = Registry()


@R.query("SELECT term, count(*) AS n FROM terms WHERE len(string_split(term, ' ')) >= 2 AND list_unique(string_split(term, ' ')) = len(string_split(term, ' ')) GROUP BY term ORDER BY n DESC, term LIMIT 60")
def concept_cloud(t: Tables) -> DataFrame:
    return T.concept_cloud(t.terms())


def best(table: str, column: str, k: int) -> str:
    return f"(SELECT {column} FROM (SELECT {column}, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, {column} LIMIT {k}))"


@R.query(f"SELECT term, year, count(*) AS n FROM terms JOIN docs USING (doc_id) WHERE year IS NOT NULL AND term IN {best('terms', 'term', 8)} GROUP BY 1, 2")
def concept_timeline(t: Tables) -> DataFrame:
    return T.timeline(t.terms(), t.docs())


@R.query(f"""
WITH w AS (SELECT doc_id, 1 / count(*) AS w FROM terms GROUP BY doc_id), d AS (SELECT doc_id, CASE WHEN {WORDS_OK} THEN {ACTIVE} END AS words FROM {BOTH})
SELECT term, doc_count, doc_equivalent, weighted_mean FROM (
SELECT term, count(*) AS doc_count, round(sum(w), 6) AS doc_equivalent, round(sum(words * w) / sum(CASE WHEN words IS NOT NULL THEN w END), 4) AS weighted_mean
FROM terms JOIN w USING (doc_id) JOIN d USING (doc_id) GROUP BY term) ORDER BY doc_count DESC, coalesce(weighted_mean, 0) DESC, term LIMIT 25""")
def concept_length_weighted(t: Tables) -> DataFrame:
    return T.weighted_length(both(t), t.terms())


@R.query("""
WITH s AS (SELECT doc_id FROM terms GROUP BY doc_id HAVING count(*) >= 2), k AS (SELECT terms.* FROM terms JOIN s USING (doc_id)),
f AS (SELECT term, count(*) AS f FROM k GROUP BY term),
p AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT term_a, term_b, n, floor(x * 10 + 0.5) / 10 AS lift FROM (
SELECT term_a, term_b, n, n * (SELECT count(*) FROM docs) / (x.f * y.f) AS x FROM p JOIN f x ON x.term = term_a JOIN f y ON y.term = term_b WHERE n / least(x.f, y.f) < 0.7)
ORDER BY x DESC, n DESC, term_a, term_b LIMIT 20""")
def term_cooccurrence_lift(t: Tables) -> DataFrame:
    return T.lift(t.terms(), t.docs().count())


def supervisors(t: Tables) -> DataFrame:
    return t.committee().filter(F.col("role").isin("Supervisor", "Co-Supervisor")).select("doc_id", "name").distinct()


SUPERVISORS = "(SELECT DISTINCT doc_id, name FROM committee WHERE role IN ('Supervisor', 'Co-Supervisor'))"


def matrix_sql(left: str, right: str, row: str, column: str, i: int, j: int) -> str:
    return f"SELECT {row}, {column}, count(*) AS n FROM {left} a JOIN {right} b USING (doc_id) WHERE {row} IN {best(left, row, i)} AND {column} IN {best(right, column, j)} GROUP BY 1, 2"


@R.query(matrix_sql(SUPERVISORS, "terms", "name", "term", 12, 10))
def supervisor_concept_matrix(t: Tables) -> DataFrame:
    return T.matrix(supervisors(t), t.terms(), "name", "term", 12, 10)


@R.query(matrix_sql("methods", "terms", "method", "term", 10, 10))
def methodology_concept_matrix(t: Tables) -> DataFrame:
    return T.matrix(t.methods(), t.terms(), "method", "term", 10, 10)


TOPICAL = "(SELECT * FROM doc_topics WHERE topic_id <> -1)"


@R.query(matrix_sql("methods", TOPICAL, "method", "topic_id", 10, 8))
def methodology_topic_matrix(t: Tables) -> DataFrame:
    return T.matrix(t.methods(), t.doc_topics().filter("topic_id <> -1"), "method", "topic_id", 10, 8)


@R.query(matrix_sql(SUPERVISORS, TOPICAL, "name", "topic_id", 12, 10))
def supervisor_topic_matrix(t: Tables) -> DataFrame:
    return T.matrix(supervisors(t), t.doc_topics().filter("topic_id <> -1"), "name", "topic_id", 12, 10)


PEOPLE = "(SELECT DISTINCT doc_id, name FROM committee WHERE coalesce(role, 'Committee Member') IN ('Supervisor', 'Co-Supervisor', 'Committee Member'))"
NODES = f"(SELECT name, count(*) AS doc_count FROM {PEOPLE} GROUP BY name ORDER BY doc_count DESC, name LIMIT 30)"
EDGES = f"(SELECT x.name AS a, y.name AS b, count(*) AS weight FROM {PEOPLE} x JOIN {PEOPLE} y ON x.doc_id = y.doc_id AND x.name < y.name WHERE x.name IN (SELECT name FROM {NODES}) AND y.name IN (SELECT name FROM {NODES}) GROUP BY 1, 2)"


def people(t: Tables) -> DataFrame:
    return t.committee().filter(F.coalesce("role", F.lit("Committee Member")).isin(*SUPERVISING)).select("doc_id", "name").distinct()


@R.query(f"SELECT * FROM {NODES}")
def supervisor_network_nodes(t: Tables) -> DataFrame:
    return T.people_network(people(t))[0]


@R.query(f"SELECT * FROM {EDGES}")
def supervisor_network_edges(t: Tables) -> DataFrame:
    return T.people_network(people(t))[1]


@R.query(f"SELECT name, count(*) AS degree FROM (SELECT a AS name FROM {EDGES} UNION ALL SELECT b FROM {EDGES}) GROUP BY name")
def network_degree(t: Tables) -> DataFrame:
    return T.degrees(T.people_network(people(t))[1])


def _slices(kind: str, rows: str, k: int) -> str:
    top = f"(SELECT value, count(*) AS n FROM {rows} GROUP BY value ORDER BY n DESC, value LIMIT {k})"
    own = f"(SELECT r.value, d.year, d.words FROM {rows} r JOIN d USING (doc_id) WHERE r.value IN (SELECT value FROM {top}))"
    return f"SELECT '{kind}' AS slice, value, NULL::INTEGER AS year, count(*) AS n, sum(words)::BIGINT AS words FROM {own} GROUP BY value UNION ALL SELECT '{kind}_by_year', value, year, count(*), sum(words)::BIGINT FROM {own} WHERE year IS NOT NULL GROUP BY value, year"


def bundle_sql(words: str) -> str:
    kinds = {
        "term": "(SELECT doc_id, term AS value FROM terms)",
        "method": "(SELECT doc_id, method AS value FROM methods)",
        "topic": "(SELECT doc_id, topic_id::VARCHAR AS value FROM doc_topics WHERE topic_id <> -1)",
        "person": "(SELECT DISTINCT l_orderkey AS doc_id, l_suppkey::VARCHAR AS value FROM lineitem WHERE l_linenumber <= 3)",
        "word": words,
    }
    parts = " UNION ALL ".join(_slices(k, rows, TOPS[k]) for k, rows in kinds.items())
    return f"WITH d AS (SELECT doc_id, year, words FROM (SELECT doc_id, year FROM docs) LEFT JOIN (SELECT doc_id, coalesce(body_word_count, word_count) AS words FROM metrics) USING (doc_id)) SELECT 'overall' AS slice, NULL::VARCHAR AS value, NULL::INTEGER AS year, count(*) AS n, sum(words)::BIGINT AS words FROM d UNION ALL SELECT 'by_year', NULL, year, count(*), sum(words)::BIGINT FROM d WHERE year IS NOT NULL GROUP BY year UNION ALL {parts}"


@R.query(bundle_sql("(SELECT DISTINCT o_orderkey AS doc_id, unnest(string_split(lower(replace(o_orderpriority, '-', ' ')), ' ')) AS value FROM orders)"))
def workbench_bundle(t: Tables) -> DataFrame:
    """The counts of all slices of a workbench; each table is scanned once, as a document's lines give its terms, methods and people."""
    line, part, orders, e = t.raw("lineitem"), t.raw("part"), t.raw("orders"), t.raw("embeddings")
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    lines = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.collect_set("p_name").alias("term"),
        F.collect_set("p_brand").alias("method"),
        F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey").cast("string"))).alias("person"),
        F.floor(F.sum(price)).cast("long").alias("all"),
        F.floor(F.sum(F.when(F.col("l_linenumber") <= 2, price))).cast("long").alias("body"),
    )
    turn = e.agg(F.coalesce(F.max("vec_id"), F.lit(0)) + 1).scalar()
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.split(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))), " ").alias("word"), (F.col("o_orderkey") % turn).alias("vec_id"))
    topic = F.when(F.col("label") != 9, F.array(F.col("label").cast("string"))).alias("topic")
    rows = rows.join(e.select("vec_id", topic), "vec_id", "left").join(lines, "doc_id", "left").withColumn("words", F.coalesce("body", "all"))
    kinds = {k: F.col(k) for k in ("term", "method", "topic", "person", "word")}
    return bundle(facts(rows, kinds))


@R.query("SELECT doc_id, overlap, year FROM (SELECT doc_id, count(*) AS overlap FROM terms WHERE doc_id <> 7 AND term IN (SELECT term FROM terms WHERE doc_id = 7) GROUP BY doc_id) JOIN docs USING (doc_id) ORDER BY overlap DESC, year DESC NULLS LAST, doc_id LIMIT 6")
def related_documents_overlap(t: Tables) -> DataFrame:
    return T.related(t.terms(), t.docs(), 7)


@R.query("""
SELECT doc_id, round(sum(s), 6) AS score FROM (
SELECT doc_id, 2.0 * count(*) AS s FROM terms WHERE doc_id <> 7 AND term IN (SELECT term FROM terms WHERE doc_id = 7) GROUP BY doc_id
UNION ALL SELECT doc_id, 0.5 * count(*) FROM methods WHERE doc_id <> 7 AND method IN (SELECT method FROM methods WHERE doc_id = 7) GROUP BY doc_id
UNION ALL SELECT a.doc_id, 2.5 * least(a.probability, b.probability) FROM doc_topics a JOIN doc_topics b ON a.topic_id = b.topic_id WHERE b.doc_id = 7 AND a.doc_id <> 7 AND a.topic_id <> -1)
GROUP BY doc_id HAVING round(sum(s), 6) > 0 ORDER BY score DESC, doc_id LIMIT 6""")
def related_documents_weighted(t: Tables) -> DataFrame:
    return T.related_weighted(t.terms(), t.methods(), t.doc_topics(), 7)


@R.query("SELECT term, n, round(n / greatest(1, max(n) OVER ()), 6) AS ratio FROM (SELECT term, count(*) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 20)")
def ratio_to_max(t: Tables) -> DataFrame:
    return T.ratio_to_max(T.top(t.terms(), "term", 20), "n")
