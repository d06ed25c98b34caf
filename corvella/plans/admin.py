"""Queries over labels, rules, settings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators import labels as L
from corvella.operators import runs as U
from corvella.operators import topics as O
from corvella.plans.registry import Registry
from corvella.sources.views import Tables

R = Registry()


@R.query("SELECT DISTINCT degree, program, affiliation, concat('degree.raw,', degree, ';program.raw,', program, ';affiliation.raw,', affiliation) AS term FROM docs")
def import_rule_terms(t: Tables) -> DataFrame:
    return U.rule_term(t.docs().select("degree", "program", "affiliation").distinct())


@R.query("SELECT DISTINCT sync_key, sha1(concat('{\"sync_key\":\"', sync_key, '\",\"degree\":\"', degree, '\"}')) AS run_key FROM docs")
def run_keys(t: Tables) -> DataFrame:
    rows = t.docs().select("sync_key", "degree").distinct()
    return rows.select("sync_key", U.run_key(F.struct("sync_key", "degree")).alias("run_key"))


@R.query("SELECT event_id AS id, event_type, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_runs(t: Tables) -> DataFrame:
    runs = t.raw("events").select(F.col("event_id").alias("id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return U.newest(runs, "at", 25)


@R.query("SELECT coalesce(b.key, a.key) AS key, coalesce(b.value, a.value) AS value FROM (SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation) a FULL OUTER JOIN (SELECT user_id::VARCHAR AS key, max_by(event_type, event_id) AS value FROM events GROUP BY 1) b ON a.key = b.key")
def settings_merged(t: Tables) -> DataFrame:
    stored = t.raw("nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    changes = t.raw("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    return U.settings(stored, changes)


@R.query("SELECT p_name AS variant, a AS fixed, b AS learned FROM (SELECT p_name, min(p_brand) AS a, max(p_brand) AS b FROM part GROUP BY p_name) WHERE a <> b")
def dictionary_conflicts(t: Tables) -> DataFrame:
    names = t.raw("part").groupBy(F.col("p_name").alias("variant"))
    return U.conflicts(names.agg(F.min("p_brand").alias("canonical")), names.agg(F.max("p_brand").alias("canonical")))


@R.query("SELECT node, left_node, right_node, distance, node = 18 AS is_root FROM (SELECT i AS node, NULL::BIGINT AS left_node, NULL::BIGINT AS right_node, 0.0::DOUBLE AS distance FROM range(10) r(i) UNION ALL SELECT 10 + i, CASE WHEN i = 0 THEN 0 ELSE 9 + i END, i + 1, (i + 1)::DOUBLE FROM range(9) r(i))")
def dendrogram_nodes(t: Tables) -> DataFrame:
    """The node table of a linkage that adds one leaf at each step."""
    step = F.col("id")
    merges = t.spark.range(9).select(step.alias("step"), F.when(step == 0, 0).otherwise(9 + step).alias("a"), (step + 1).alias("b"), (step + 1).cast("double").alias("distance"))
    return O.tree_nodes(merges, 10)


def _candidates(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in ("Topic 3: Reading in the Early Grades", "arts, music, dance, drama", "research topic", "Policy", "Learning and Teaching of Science")])
    return t.raw("labels").select((d % 12).cast("int").alias("topic_id"), F.get(names, (d % 5).cast("int")).alias("label"), d.alias("created"))


def _default(t: Tables) -> DataFrame:
    return t.topics().select("topic_id", "label")


CASES = """(SELECT (doc_id % 12)::INTEGER AS topic_id, ['Reading in the Early Grades', 'arts, music, dance, drama', NULL, 'Policy', 'Learning and Teaching of Science'][doc_id % 5 + 1] AS label, doc_id AS created,
 [0, 30, 100, 20, 0][doc_id % 5 + 1] AS cost FROM labels)"""


@R.query(f"SELECT topic_id, label, created, greatest(0, 100 - cost - CASE WHEN first_topic < topic_id AND label IS NOT NULL THEN 60 ELSE 0 END)::INTEGER AS score FROM (SELECT *, min(topic_id) OVER (PARTITION BY label) AS first_topic FROM {CASES})")
def label_scores(t: Tables) -> DataFrame:
    return L.scored(_candidates(t), _default(t)).select("topic_id", "label", "created", "score")


@R.query()
def label_choice(t: Tables) -> DataFrame:
    """Chosen labels with repeats numbered."""
    default = _default(t)
    overrides = default.filter("topic_id = 2").select("topic_id", F.lit("Chosen by Hand").alias("label"))
    return L.numbered(L.choose(default, overrides, L.scored(_candidates(t), default), default).select("topic_id", "label"))


@R.query()
def label_evidence(t: Tables) -> DataFrame:
    """What the documents of each topic say against its label."""
    rows = t.topics().select("topic_id", F.concat_ws(" ", F.lit("Building Machinery Furniture"), F.col("topic_id").cast("string")).alias("label"), "doc_count")
    evidence = t.doc_topics().join(t.docs(), "doc_id").select("topic_id", "title", F.col("degree").alias("abstract"))
    return L.evidence_warnings(rows, evidence)
