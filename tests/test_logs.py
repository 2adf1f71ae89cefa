"""Telemetry logs with line numbers, and placements that one of two racing writers commits."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from kelpie.operators import store
from kelpie.sources import readers, scratch

GOOD = {"event_id": "1", "task_id": "t", "kind": "resident_hit", "item_id": "a"}


def log(tmp_path, *lines):
    (tmp_path / "log.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(tmp_path / "log.jsonl")


def test_errors_name_their_lines(spark, tmp_path):
    bad = [
        ("{broken", "expected object"), (GOOD | {"event_id": "2", "used": True}, "unsupported field used"), (GOOD | {"event_id": "3", "extra_tokens": -1}, "negative"), (GOOD | {"event_id": "4", "extra_tokens": 1.5}, "another type"),
        (GOOD | {"event_id": "5", "avoidable": "true"}, "another type"), (GOOD | {"event_id": 6}, "another type"), (GOOD | {"event_id": "7", "kind": "hit"}, "unsupported kind"), (GOOD | {"event_id": "8", "item_id": " "}, "item_id is needed"),
        (GOOD | {"event_id": "9", "kind": "prefetch"}, "need used"), (GOOD | {"event_id": "10", "kind": "prefetch", "used": False, "mode": "x"}, "unsupported mode"), (GOOD | {"event_id": "11", "kind": "prefetch", "used": True, "confidence": 1.5}, "share"),
        (GOOD | {"event_id": "", "task_id": "t"}, "are needed"), ("[1]", "expected object"), (GOOD | {"task_id": "other"}, "duplicate event_id 1"),
    ]
    events, errors = readers.telemetry_log(spark, log(tmp_path, GOOD, "", *(b for b, _ in bad), GOOD | {"event_id": "12", "kind": "prefetch", "used": True}, GOOD | {"event_id": "13", "kind": "stale_resident_failure", "item_id": None}))
    got = {r.line: r.error for r in errors.collect()}
    assert sorted(got) == list(range(3, 3 + len(bad)))
    for n, (_, message) in enumerate(bad, 3):
        assert message in got[n], (n, got[n])
    rows = {r.event_id: r for r in events.collect()}
    assert sorted(rows) == ["1", "12", "13"] and (rows["1"].line, rows["12"].line) == (1, 3 + len(bad)) and rows["12"]["mode"] == "locator" and rows["1"].extra_tokens == 0 and rows["1"].avoidable is False
    with pytest.raises(ValueError, match=r"log.jsonl:3: expected object"):
        readers.telemetry_jsonl(spark, str(tmp_path / "log.jsonl"))
    assert readers.telemetry_jsonl(spark, log(tmp_path, GOOD)).count() == 1


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k} {'x' * (k % 50)}\n" for k in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert rows.count() == 6000 and rows.filter(F.regexp_extract("value", r"^[ab](\d+)", 1).cast("int") != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_of_two_racing_writers_commits(spark):
    path = scratch.folder(spark)
    state = spark.createDataFrame([("e", "T0")], "id string, tier string")
    assert store.commit(spark, path, state, 0) == 1
    results = []

    def write(tier):
        try:
            results.append((tier, store.commit(spark, path, state.withColumn("tier", F.lit(tier)), 1)))
        except ValueError as e:
            results.append((tier, str(e)))

    threads = [threading.Thread(target=write, args=(t,)) for t in ("T1", "T2", "T3")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [t for t, r in results if r == 2]
    assert len(won) == 1 and store.latest_revision(spark, path) == 2 and [r.tier for r in store.revision(spark, path, 2).collect()] == won
    assert store.rollback(spark, path, 1) == 3 and [r.tier for r in store.revision(spark, path, 3).collect()] == ["T0"]
    with pytest.raises(ValueError, match="revision is 3, not 1"):
        store.commit(spark, path, state, 1)
