"""The keyed table over several batches, and appended results as tables."""

import pytest
from pyspark.sql import functions as F

from corvella.streaming import ingest as S

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


@pytest.fixture
def batches(spark, tmp_path):
    """Five files of which later ones bring newer, older and repeated rows of some users."""
    place = f"{tmp_path}/in"
    for n in range(5):
        rows = [(100 * n + i, (i * (n + 1)) % 37, "ab"[i % 2], float(i), 1_700_000_000 + (i * 7919 + n * 104729) % 100_000) for i in range(60)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").select("event_id", "user_id", "event_type", "value", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(place)
    return place


def test_upsert_over_batches(spark, batches, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(batches)
    got = S.run_upsert(stream, f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts", bucket_rows=8)
    want = S.latest(spark.read.schema(SCHEMA).parquet(batches), "user_id")
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_id", "event_type", "value").collect()))
    assert key(got) == key(want)


def test_upsert_leaves_other_buckets_alone(spark, batches, tmp_path):
    one = spark.read.schema(SCHEMA).parquet(batches).filter("user_id = 3")
    S.run_upsert(spark.readStream.schema(SCHEMA).parquet(batches), f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts", bucket_rows=8)
    one.limit(1).withColumn("event_id", F.lit(10**6).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(1_900_000_000))).select("event_id", "user_id", "event_type", "value", "ts").coalesce(1).write.mode("append").parquet(batches)
    got = S.run_upsert(spark.readStream.schema(SCHEMA).parquet(batches), f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts", bucket_rows=8)
    buckets, held = S.KeyedTable(spark, f"{tmp_path}/table", "user_id", "ts", one.schema).standing()
    assert buckets > 4 and sorted(v for v, _ in held.values()).count(1) == 1 and len(list((tmp_path / "table" / "rows" / "v=1").glob("__bucket=*"))) == 1
    assert got.filter("user_id = 3").first()["event_id"] == 10**6
    assert got.count() == spark.read.parquet(batches).select("user_id").distinct().count()


def states(tmp_path):
    return sorted(p.name for p in (tmp_path / "table" / "standing").iterdir())


def test_upsert_again_without_new_rows(spark, batches, tmp_path):
    run = lambda: sorted(map(tuple, S.run_upsert(spark.readStream.schema(SCHEMA).parquet(batches), f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts").collect()))
    first = run()
    assert first and run() == first and run() == first


def test_upsert_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert S.run_upsert(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts").collect() == []


def test_batch_stopped_between_rows_and_state(spark, batches, tmp_path, monkeypatch):
    """The rows of a batch are written, what it stands at is not: readers see the state before, and the next run does the batch again."""
    files = sorted((tmp_path / "in").glob("*.parquet"))
    aside = tmp_path / "later.parquet"
    files[0].rename(aside)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(batches)
    run = lambda: S.run_upsert(stream(), f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts", bucket_rows=8)
    before = sorted(map(tuple, run().collect()))
    aside.rename(tmp_path / "in" / "later.parquet")
    monkeypatch.setattr(S.KeyedTable, "_written", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    table = S.KeyedTable(spark, f"{tmp_path}/table", "user_id", "ts", stream().schema)
    assert (tmp_path / "table" / "rows" / "v=1").exists() and sorted(map(tuple, table.read().collect())) == before
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_id", "event_type", "value").collect()))
    assert key(run()) == key(S.latest(spark.read.schema(SCHEMA).parquet(batches), "user_id")) and key(run()) != []


def test_buckets_grow_and_old_states_go(spark, batches, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(batches)
    S.run_upsert(stream, f"{tmp_path}/table", f"{tmp_path}/state", "user_id", "ts", bucket_rows=20)
    table = S.KeyedTable(spark, f"{tmp_path}/table", "user_id", "ts", stream.schema)
    buckets, held = table.standing()
    assert buckets >= 4 and len(held) <= buckets and sum(n for _, n in held.values()) == 37
    assert states(tmp_path) == ["e=3", "e=4"]


def test_drain_is_a_table(spark, batches, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(batches)
    got = S.drain(S.deduplicated(stream, ["user_id"], "60 days"), f"{tmp_path}/out")
    assert got.count() == spark.read.parquet(batches).select("user_id").distinct().count()
