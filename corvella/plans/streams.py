"""Queries over the event stream and job tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators.cut import shared_dir
from corvella.plans.registry import Registry
from corvella.sources.commits import TableGroup, WorkQueue, refresh
from corvella.sources.views import Tables
from corvella.streaming import ingest as S
from corvella.streaming import stateful as K

R = Registry()


def scratch(t: Tables) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(t.spark)}/corvella-stream-{uuid.uuid4().hex}"


def events(t: Tables) -> DataFrame:
    return t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@R.query(LATEST)
def stream_incremental_upsert(t: Tables) -> DataFrame:
    """The events drained into a table keyed by user, batch by batch."""
    place = scratch(t)
    return S.run_upsert(S.read_events(t.spark, t.folder), f"{place}/table", f"{place}/state", "user_id", "ts").select("user_id", "event_id", "event_type", "value")


@R.query(LATEST)
def latest_run_per_key(t: Tables) -> DataFrame:
    return S.latest(events(t), "user_id").select("user_id", "event_id", "event_type", "value")


WINDOWS = "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
#: Windows that the watermark has passed when the stream ends.
CLOSED = "WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@R.query(f"SELECT event_type, epoch(start)::BIGINT AS start, n, total FROM ({WINDOWS})")
def windowed_counts(t: Tables) -> DataFrame:
    return S.windowed_counts(events(t)).withColumn("start", F.unix_timestamp("start"))


@R.query(f"SELECT event_type, epoch(start)::BIGINT AS start, n, total FROM ({WINDOWS}) {CLOSED}")
def stream_windowed_counts_watermark(t: Tables) -> DataFrame:
    out = S.drain(S.windowed_counts(S.read_events(t.spark, t.folder)), scratch(t))
    return out.withColumn("start", F.unix_timestamp("start"))


@R.query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_deduplicated(t: Tables) -> DataFrame:
    out = S.drain(S.deduplicated(S.read_events(t.spark, t.folder), ["user_id", "event_type"], "60 days"), scratch(t))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("""
SELECT event_id, user_id, in_window, in_window <= 2 AS allowed FROM (
 SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)""")
def rate_window_counts(t: Tables) -> DataFrame:
    return S.rate_windows(events(t))


#: Rows that the watermark has passed when the stream ends, in whole milliseconds.
MARK = "(SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events)"


@R.query(f"""
SELECT event_id, user_id, in_window, in_window <= 2 AS allowed FROM (
 SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)
WHERE (epoch_us(ts) + 999) // 1000 < {MARK}""")
def stream_rate_limited(t: Tables) -> DataFrame:
    """The rate limit as an operator with keyed state."""
    with K.keyed_state(t.spark):
        return S.drain(K.limited(S.read_events(t.spark, t.folder)), scratch(t))


@R.query(f"""
SELECT user_id, event_id, us AS last_us, us + 21600000000 AS lost_us FROM (
 SELECT user_id, event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
WHERE (us + 999) // 1000 < {MARK} AND coalesce(following - us >= 21600000000, true) AND (us + 21600000000 + 999) // 1000 < {MARK}""")
def stream_lost_heartbeats(t: Tables) -> DataFrame:
    """Silences of six hours, by timers on event time."""
    with K.keyed_state(t.spark):
        return S.drain(K.lost(S.read_events(t.spark, t.folder), 6 * 3600), scratch(t))


@R.query("SELECT id, upper(text) AS found FROM (SELECT s_suppkey AS id, s_name AS text FROM supplier WHERE s_acctbal >= 0)")
def pending_drained(t: Tables) -> DataFrame:
    """Two jobs drain a leased queue of lookups; those that fail stay pending, and the second job does not try them again."""
    items = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"), "s_acctbal")
    place = scratch(t)
    queue = WorkQueue(t.spark, f"{place}/queue")

    def lookup(page: DataFrame) -> DataFrame:
        return page.filter("s_acctbal >= 0").select("id", F.upper("text").alias("found"))

    def save(found: DataFrame) -> None:
        found.write.mode("append").parquet(f"{place}/found")

    n = items.count()
    first = queue.drain(items, lookup, save, "first", page=n // 3 + 1, cap=n // 2)
    queue.drain(items, lookup, save, "second", page=n // 3 + 1, run=first["run"])
    return t.spark.read.schema("id long, found string").parquet(f"{place}/found")


@R.query("SELECT 'topics' AS name, count(*) AS n FROM topics UNION ALL SELECT 'doc_topics', count(*) FROM doc_topics UNION ALL SELECT 'coordinates', count(*) FROM doc_topics WHERE x > 0")
def topic_tables_refreshed(t: Tables) -> DataFrame:
    """Three tables replaced in one commit, twice; the second time with other rows."""
    group = TableGroup(t.spark, f"{scratch(t)}/tables")
    tables = {"topics": t.topics(), "doc_topics": t.doc_topics(), "coordinates": t.doc_topics().filter("x > 0").select("doc_id", "x", "y")}
    refresh(group, {k: v.limit(1) for k, v in tables.items()})
    refresh(group, tables)
    group.vacuum(keep=1)
    counts = [group.read(k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.query("""
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions(t: Tables) -> DataFrame:
    return S.sessions(events(t)).withColumn("start", F.unix_micros("start"))


JOBS = "(SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'done' END AS status, ts + INTERVAL 1 HOUR AS timeout_at FROM events)"


@R.query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN id = 1 AND status = 'queued' THEN 'running' WHEN status = 'running' AND timeout_at <= TIMESTAMP '2024-01-15' THEN 'timed_out' ELSE status END AS status FROM {JOBS}) GROUP BY status")
def claim_and_reap_jobs(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "click", "queued").otherwise("done")
    jobs = events(t).select(F.col("event_id").alias("id"), status.alias("status"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("timeout_at"), F.lit(None).cast("string").alias("runner"))
    out = S.claim(S.reap(jobs, "2024-01-15"), 1, "r1")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT event_type, count(*) AS n, bool_and(value >= 0) AS all_ok, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def import_totals(t: Tables) -> DataFrame:
    """Sums over runs, and whether all of a kind went well."""
    return t.raw("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") >= 0).alias("all_ok"), F.round(F.sum("value"), 4).alias("total"))
