"""Operators with keyed state: the stream, in several batches with late rows, equals the batch form."""

import datetime as dt
import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvella.streaming import ingest, stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def arrivals():
    """Batches of rows; some come up to 90 minutes after later ones."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        at = rng.choice([i * 40, i * 40 + rng.randint(0, 30)])
        rows.append((i, START + dt.timedelta(seconds=at, microseconds=rng.randint(0, 999_999)), rng.choice([1, 1, 2, 3]) if i % 100 < 70 else 1, "e", 1.0))
    rows += [(1000 + i, rows[50][1], 2, "e", 1.0) for i in range(4)]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.choice([0, 0, 0, 5000])))
    return [late[i : i + 80] for i in range(0, len(late), 80)]


def streamed(spark, tmp_path, arrivals, operator):
    """Each batch is a file of its own, one taken at a time."""
    for i, batch in enumerate(arrivals):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with stateful.keyed_state(spark):
        out = ingest.drain(operator(stream), f"{tmp_path}/out")
    assert spark.conf.get(stateful.PROVIDER, None) != stateful.ROCKS
    return out


def mark(arrivals):
    return int(max(r[1] for b in arrivals for r in b).replace(tzinfo=dt.UTC).timestamp() * 1000) - 2 * 3600 * 1000


def test_rate_limit(spark, tmp_path, arrivals):
    whole = spark.createDataFrame([r for b in arrivals for r in b], SCHEMA)
    want = ingest.rate_windows(whole).join(whole.select("event_id", "ts"), "event_id").filter(F.ceil(F.unix_micros("ts") / 1000) < mark(arrivals)).drop("ts")
    got = streamed(spark, tmp_path, arrivals, stateful.limited)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("NOT allowed").count() > 0


def test_heartbeats(spark, tmp_path, arrivals):
    whole = spark.createDataFrame([r for b in arrivals for r in b], SCHEMA)
    want = sorted(map(tuple, stateful.lost_in(whole, mark(arrivals), 300).collect()))
    got = sorted(map(tuple, streamed(spark, tmp_path, arrivals, lambda s: stateful.lost(s, 300)).collect()))
    assert got == want and len(got) > 5


class Held:
    """A handle whose states count what goes in and out of them."""

    def __init__(self):
        self.moved, self.held, self.timers = 0, {}, []

    def getValueState(self, name, schema):
        return HeldState(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.moved += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.moved += 1
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class HeldState:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        self.handle.moved += 1
        return self.name in self.handle.held

    def get(self):
        found = self.handle.held.get(self.name)
        self.handle.moved += len(found) if isinstance(found, list) else 1
        return found

    def update(self, value):
        self.handle.moved += 1
        self.handle.held[self.name] = value

    def put(self, rows):
        self.handle.moved += len(rows)
        self.handle.held[self.name] = list(rows)

    def appendList(self, rows):
        self.put([*self.handle.held.get(self.name, []), *rows])

    def clear(self):
        self.handle.moved += 1
        self.handle.held.pop(self.name, None)


@pytest.mark.parametrize("operator", [stateful.Heartbeat(5), stateful.RateLimit(60, 2)])
def test_a_key_costs_as_much_for_many_rows(operator):
    """State and timers move a few values for each batch of a key, whatever its rows; one timer is left."""
    handle, found = Held(), 0
    operator.init(handle)
    for n in range(4):
        rows = pd.DataFrame({"at": [(n * 1000 + i) * 1_000_000 for i in range(1000) if i % 100 < 90], "unnamed": 0, "event_id": range(900)})
        before = handle.moved
        found += sum(len(x) for x in operator.handleInputRows((7,), iter([rows]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda at=max(0, n * 1000 - 500) * 1000: at)))
        assert handle.moved - before <= 5 and len(handle.timers) == 1
    # 24 pauses between settled rows and the one after the last, given up five seconds later.
    assert found == (25 if isinstance(operator, stateful.Heartbeat) else 2250)


def test_rows_without_number_or_time(spark, tmp_path):
    """A null number is a row like any other and the last of its time; a null time is no row."""
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1, "e", 1.0), (None, at(0), 1, "e", 1.0), (2, at(1000), 1, "e", 1.0), (3, None, 1, "e", 1.0), (4, at(90_000), 2, "e", 1.0)]
    got = streamed(spark, tmp_path, [rows], lambda s: stateful.lost(s, 300))
    assert sorted((r.event_id or 0, r.last_us % 10**10) for r in got.collect()) == sorted((i, (int(START.replace(tzinfo=dt.UTC).timestamp()) + s) * 10**6 % 10**10) for i, s in [(0, 0), (2, 1000)])
