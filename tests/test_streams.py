"""Exactly-once scopes and ordered replay."""

import datetime

import pytest
from pyspark.sql import functions as F

from kelpie.sources import scratch
from kelpie.streaming import replay, sync

MESSAGES = "session string, ord int, role string, text string, timestamp string, revision bigint, summary boolean"


def batch(spark, rows):
    return sync.documents(spark.createDataFrame(rows, MESSAGES))


def state(spark, path):
    return sorted((r.scope, r.ord, r.text, r.batch) for r in sync.current(spark, path).collect())


def test_scopes_are_versioned_and_batches_idempotent(spark):
    path = scratch.folder(spark)
    assert state(spark, path) == []
    first = [("a", 0, "user", "hello", None, 1, None), ("a", 1, "assistant", "hi", "t", 1, False), ("b", 0, "user", "yo", "", 1, False), ("a", 2, "system", "no", "", 1, False), ("a", 3, "user", "", "", 1, False), ("a", 4, "user", "s", "", 1, True)]
    sync.apply(batch(spark, first), 0, path)
    want = [("live::a", 0, "hello", 0), ("live::a", 1, "hi", 0), ("live::b", 0, "yo", 0)]
    assert state(spark, path) == want
    sync.apply(batch(spark, [("a", 0, "user", "other", "", 9, False)]), 0, path)  # delivered again under a committed number
    assert state(spark, path) == want
    sync.apply(batch(spark, [("a", 0, "user", "old", "", 0, False), *first[:2]]), 1, path)  # nothing new: no new version
    assert state(spark, path) == want
    sync.apply(batch(spark, [("a", 5, "user", "more", "", 1, False), ("a", 0, "user", "hello!", "", 2, False)]), 2, path)
    assert state(spark, path) == [("live::a", 0, "hello!", 2), ("live::a", 1, "hi", 2), ("live::a", 5, "more", 2), ("live::b", 0, "yo", 0)]


def test_a_batch_that_was_not_committed_is_not_seen_and_overwritten(spark):
    path = scratch.folder(spark)
    sync.apply(batch(spark, [("a", 0, "user", "one", "", 1, False)]), 0, path)
    batch(spark, [("a", 0, "user", "half", "", 7, False), ("c", 0, "user", "half", "", 7, False)]).write.parquet(f"{path}/data/batch=1")  # a driver that died before its commit
    assert state(spark, path) == [("live::a", 0, "one", 0)]
    sync.apply(batch(spark, [("a", 0, "user", "two", "", 2, False)]), 1, path)
    assert state(spark, path) == [("live::a", 0, "two", 1)]


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(conf)


def test_replay_of_disordered_deliveries_equals_the_batch(spark, rocks):
    day = lambda d, s=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=s)
    uses = [("x", f"e{k}", day(k * 2 % 31, k)) for k in range(31)] + [("y", "a", day(3)), ("y", "b", day(3)), ("y", "c", day(40)), ("x", "late", day(9, 5))]
    folder = scratch.folder(spark)
    schema = "entry_id string, event_id string, ts timestamp"
    deliveries = [[u for u in uses if u[2] < day(15)][::-1], [u for u in uses if u[2] >= day(15)], uses[4:9] + [u for u in uses if u[2] >= day(30)], [("", "end", day(4000))]]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = replay.replayed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "40 days", window_days=5, daily_cap=3.0)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    shown = lambda df: sorted((r.entry_id, r.event_id, r.ts, r.ordinal, round(r.activity_before, 9)) for r in df.collect())
    got = shown(spark.read.schema(replay.OUT).parquet(f"{folder}/out"))
    assert got == shown(replay.replayed_batch(spark.createDataFrame(uses, schema), window_days=5, daily_cap=3.0)) and len(got) == len(uses)


def test_the_plain_kernel_is_that_of_the_columns(spark):
    from kelpie.functions import scalars

    got = spark.range(181).select("id", scalars.decay(F.col("id"), "bounded_power").alias("w")).collect()
    assert all(abs(r.w - replay.decay(r.id)) < 1e-12 for r in got)
