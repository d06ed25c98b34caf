"""Incremental ingest and time-bounded queries with Structured Streaming, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.operators.merge import last_of
from corvella.sources.commits import Storage


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, with timestamps that watermarks accept."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def merge_latest(state: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key in state and batch together; idempotent, so a batch may be replayed."""
    rows = batch if state is None else state.unionByName(batch)
    return last_of(rows, [key], [F.desc(order), F.desc("event_id")])


#: Rows that a bucket of a keyed table holds at most, about.
BUCKET_ROWS = 1_000_000


class KeyedTable:
    """A table of one row a key as Parquet, in buckets of keys, with one state a batch of the stream that writes it.

    A batch rewrites the buckets that it touches, in a folder of its number, and then writes
    what each bucket stands at: which number, how many rows, and how many buckets there are.
    Spark writes _SUCCESS last, so a batch that was stopped in between is not seen, and trying
    it again writes the same rows to the same places. Buckets double when they get large;
    rewriting them is the next batch's work. Of former states one is kept for readers.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.key, self.order, self.schema, self.bucket_rows = spark, key, order, schema, bucket_rows
        self.storage = Storage(spark, path)
        self.path = self.storage.base

    def epochs(self) -> list[int]:
        """Batches that were written completely."""
        return sorted(int(n[2:]) for n in self.storage.names("standing") if self.storage.exists(f"standing/{n}/_SUCCESS"))

    def standing(self, before: int | None = None) -> tuple[int, dict[int, tuple[int, int]]]:
        """(number of buckets, bucket to (batch, rows)) of the last complete state, before a batch if one is named. One row a bucket."""
        found = [e for e in self.epochs() if before is None or e < before]
        if not found:
            return 1, {}
        rows = self.spark.read.schema("bucket int, version long, n long, buckets int").parquet(f"{self.path}/standing/e={found[-1]}").collect()
        return rows[0]["buckets"], {r["bucket"]: (r["version"], r["n"]) for r in rows if r["bucket"] >= 0}

    def _stored(self, held: dict[int, tuple[int, int]]) -> DataFrame | None:
        places = [f"{self.path}/rows/v={v}/__bucket={b}" for b, (v, _) in held.items()]
        return self.spark.read.schema(self.schema).parquet(*places) if places else None

    def read(self) -> DataFrame:
        table = self._stored(self.standing()[1])
        return self.spark.createDataFrame([], self.schema) if table is None else table

    def merge(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        buckets, held = self.standing(epoch)
        known = sum(n for _, n in held.values()) + batch.count()
        wanted = buckets
        while known > wanted * self.bucket_rows:
            wanted *= 2
        of = lambda n: F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")
        if wanted == buckets:
            touched = [r["b"] for r in batch.select(of(buckets).alias("b")).distinct().collect()]
        else:
            touched = list(held)  # all rows go to new buckets
        old = self._stored({b: held[b] for b in touched if b in held})
        now = {} if wanted != buckets else {b: x for b, x in held.items() if b not in touched}
        merge_latest(old, batch, self.key, self.order).withColumn("__bucket", of(wanted)).write.partitionBy("__bucket").mode("overwrite").parquet(f"{self.path}/rows/v={epoch}")
        fresh = self.spark.read.schema(f"{self.key} {self.schema[self.key].dataType.simpleString()}, __bucket int").parquet(f"{self.path}/rows/v={epoch}").groupBy("__bucket").count().collect() if self.storage.names(f"rows/v={epoch}/__bucket=*") else []
        now |= {r["__bucket"]: (epoch, r["count"]) for r in fresh}
        batch.unpersist()
        self._written(epoch, wanted, now)
        self._forget(epoch)

    def _written(self, epoch: int, buckets: int, now: dict[int, tuple[int, int]]) -> None:
        """Makes a batch's rows visible."""
        rows = [(b, v, n, buckets) for b, (v, n) in now.items()] or [(-1, epoch, 0, buckets)]
        self.spark.createDataFrame(rows, "bucket int, version long, n long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/standing/e={epoch}")

    def _forget(self, epoch: int, keep: int = 2) -> None:
        """Removes states before the last `keep`, and the rows that no state has."""
        kept = [e for e in self.epochs() if e <= epoch][-keep:]
        used = {(v, b) for e in kept for b, (v, _) in self.standing(e + 1)[1].items()}
        for name in self.storage.names("standing"):
            if int(name[2:]) < kept[0]:
                self.storage.delete(f"standing/{name}")
        for name in self.storage.names("rows"):
            v = int(name[2:])
            if v < kept[0] and not any(x == v for x, _ in used):
                self.storage.delete(f"rows/{name}")


def run_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Drains the stream into a keyed table under `path` and gives the table as it then stands, also where nothing new has come."""
    table = KeyedTable(stream.sparkSession, path, key, order, stream.schema, bucket_rows)
    query = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def drain(stream: DataFrame, path: str) -> DataFrame:
    """All rows that a stream appends until its source is exhausted, as a table under `path`."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, start, n, total in tumbling windows; events later than the watermark are dropped from a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events without repeats of the keys; a stream remembers keys for the watermark's time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def rate_windows(events: DataFrame, seconds: int = 60, limit: int = 2) -> DataFrame:
    """event_id, user_id, in_window, allowed: events of the user in the seconds up to each, and whether they are within the limit."""
    at = F.unix_micros("ts")
    recent = W.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(recent)).select("event_id", "user_id", "in_window", (F.col("in_window") <= limit).alias("allowed"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n: runs of events with no pause as long as the gap."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def latest(events: DataFrame, key: str, order: str = "ts") -> DataFrame:
    """The last row of each key, found by a combinable maximum and not by a sort of each key's rows."""
    rest = [c for c in events.columns if c not in (key, order, "event_id")]
    newest = F.max(F.struct(order, "event_id", *rest)).alias("m")
    return events.groupBy(key).agg(newest).select(key, "m.*")


def reap(jobs: DataFrame, now: str) -> DataFrame:
    """jobs(status, timeout_at) with running ones that are out of time marked timed_out."""
    over = (F.col("status") == "running") & (F.col("timeout_at") <= F.lit(now).cast("timestamp"))
    return jobs.withColumn("status", F.when(over, "timed_out").otherwise(F.col("status")))


def claim(jobs: DataFrame, job_id: int, runner: str) -> DataFrame:
    """jobs with one queued, unclaimed job given to a runner; claiming it again changes nothing."""
    free = (F.col("id") == job_id) & (F.col("status") == "queued") & F.col("runner").isNull()
    return jobs.withColumns({"status": F.when(free, "running").otherwise(F.col("status")), "runner": F.when(free, F.lit(runner)).otherwise(F.col("runner"))})


def drain_pending(pending: DataFrame, lookup: Callable[[DataFrame], DataFrame], done: DataFrame, page: int) -> DataFrame:
    """Results of one page of pending work, none of it done before; rows that a lookup leaves out stay pending."""
    return lookup(pending.join(done.select("id"), "id", "left_anti").orderBy("id").limit(page))
