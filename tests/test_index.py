"""The entry index, embedding tables and planners on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import scalars as S
from kelpie.operators import embedding, evaluate, index, planners

def today():
    return F.lit("2026-09-06").cast("date")


def test_seeding_never_revives(spark):
    texts = spark.createDataFrame([("m", "alpha text"), ("m", "beta text"), ("m", "alpha text")], "store string, text string")
    none = index.seeded(spark.createDataFrame([], "source_hash string, store string"), texts, today())
    assert none.count() == 2 and none.first().next_review == dt.date(2026, 9, 9)
    dead = none.filter("key = 'alpha text'").withColumn("status", F.lit("deleted"))
    assert [r.key for r in index.seeded(dead, texts, today()).collect()] == ["beta text"]


def test_finding_needs_one(spark):
    texts = spark.createDataFrame([("m", "alpha " + "x" * 80 + " needle"), ("m", "beta needle")], "store string, text string")
    e = index.seeded(spark.createDataFrame([], "source_hash string, store string"), texts, today())
    with pytest.raises(ValueError, match="AMBIGUOUS"):
        index.only(index.found(e, texts, "needle"))
    with pytest.raises(ValueError, match="NOT_FOUND"):
        index.only(index.found(e, texts, "nowhere"))
    one = index.only(index.found(e, texts, "beta")).first()
    assert index.only(index.found(e, texts, one.id)).first().id == one.id


def test_feedback_and_reviews(spark):
    texts = spark.createDataFrame([("m", "alpha"), ("m", "beta")], "store string, text string")
    e = index.seeded(spark.createDataFrame([], "source_hash string, store string"), texts, today())
    a, b = (r.id for r in e.orderBy("key").collect())
    old = spark.createDataFrame([(a, "1", "hit", dt.date(2026, 9, 1))], "entry_id string, event_id string, type string, t date")
    new = spark.createDataFrame([(a, "1", "hit", None), (a, "2", "confirm", "seen"), (a, "3", "confirm", "seen"), (b, "4", "confirm", " "), ("zz", "5", "hit", None), (b, "6", "hit", None)], "entry_id string, event_id string, type string, evidence string")
    got = index.fed_back(old, new, e, texts, today())
    assert {r.event_id: r.outcome for r in got.collect()} == {"1": "DUPLICATE", "2": "OK", "3": "ALREADY_CONFIRMED_TODAY", "4": "CONFIRMATION_EVIDENCE_REQUIRED", "5": "ENTRY_NOT_FOUND", "6": "OK"}
    moved = {r.id: (r.review_stage, r.next_review) for r in index.reviewed(e, got, today()).collect()}
    assert moved[a] == (1, dt.date(2026, 9, 13)) and moved[b] == (0, dt.date(2026, 9, 9))
    gone = {r.event_id: r.outcome for r in index.fed_back(old, new, e, texts.filter("text <> 'beta'"), today()).collect()}
    assert gone["6"] == "SOURCE_CHANGED_OR_REMOVED"
    assert {r.id: r.pinned for r in index.pinned(e, spark.createDataFrame([(a,)], "id string")).collect()} == {a: True, b: False}


def test_migration_needs_one_match(spark):
    texts = spark.createDataFrame([("m", "  first line\n\n second  "), ("m", "same"), ("m", "same ")], "store string, text string")
    old = spark.createDataFrame([("1", "m", "first line second", "first line second", "high", None), ("2", "m", "same", "same", "low", None)], "id string, store string, key string, summary string, cost_class string, pinned boolean")
    got = {r.id: (r.status, r.pinned) for r in index.migrated(old, texts).collect()}
    assert got == {"1": ("active", True), "2": ("unresolved_legacy", False)}


def test_receipts_are_created_once(spark, tmp_path):
    index.receipt(spark.range(1), str(tmp_path / "r"))
    with pytest.raises(Exception):  # noqa: B017
        index.receipt(spark.range(1), str(tmp_path / "r"))


def test_embedding_refresh_encodes_changes_only(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, text string").withColumn("hash", F.sha2("text", 256))
    encoder = lambda texts: np.array([[len(t), ord(t[0])] for t in texts], dtype=float)
    first = embedding.refreshed(docs, spark.createDataFrame([], "id string, hash string, vector array<double>"), encoder).cache()
    assert {r.id: r.vector for r in first.collect()} == {"a": [1.0, 120.0], "b": [1.0, 121.0], "c": [1.0, 120.0]}
    changed = docs.withColumn("text", F.when(F.col("id") == "b", "zz").otherwise(F.col("text"))).withColumn("hash", F.sha2("text", 256))

    def picky(texts):
        assert texts == ["zz"]
        return encoder(texts)

    assert {r.id: r.vector for r in embedding.refreshed(changed, first, picky).collect()}["b"] == [2.0, 122.0]
    back = embedding.unpacked(embedding.packed(first))
    assert {r.id: r.vector for r in back.collect()} == {r.id: r.vector for r in first.collect()}
    inputs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "q")], "seq int, text string")
    _, counts = embedding.cached(inputs, first.select("hash", "vector").dropDuplicates(["hash"]))
    assert tuple(counts.first()) == (1, 1)
    assert embedding.from_json(spark.createDataFrame([("a", "[1, 2.5]")], "id string, vector string")).first().vector == [1.0, 2.5]


def test_planner_choices(spark):
    schema = "id string, workload string, p95 double, queue_depth int, concurrency int, model_warm boolean, startup double, provider_ready boolean, compile double, index_resident boolean, stage_ms double, cpu_seconds double"
    p = spark.createDataFrame([("a", "w", 10.0, 0, 1, True, None, True, None, True, None, 1.0), ("b", "w", 5.0, 0, 1, False, 50.0, True, None, True, None, 1.0), ("c", "w", 1.0, 0, 1, True, None, True, None, False, None, 1.0)], schema)
    assert planners.select_interactive(p, 100.0).first().id == "a"
    assert {r.id: r.finish for r in planners.predicted_finish(p).collect()} == {"a": 10.0, "b": 55.0, "c": None}
    c = spark.createDataFrame([("x", True, True, 5.0, 10.0, 0.0, 0.0, 1.0, 1.0), ("y", True, True, 8.0, 0.0, 0.0, 0.0, 9.0, 2.0), ("z", False, True, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("n", True, True, None, 0.0, 0.0, 0.0, 1.0, 1.0)], "id string, current boolean, semantic_safe boolean, latency_ms double, transfer_ms double, startup_ms double, compile_ms double, throughput double, cpu_seconds double")
    chosen = lambda o, n=1: [r.id for r in planners.joint_choice(c, o, n).collect() if r.chosen]
    assert (chosen("interactive"), chosen("interactive", 10), chosen("bulk"), chosen("background")) == (["y"], ["x"], ["y"], ["x"])
    assert {r.id: r.reasons for r in planners.joint_choice(c, "bulk").collect()} == {"x": "", "y": "", "z": "stale-profile-or-generation", "n": "unknown-cost"}
    t = spark.createDataFrame([("b1", "embed", 5.0), ("b1", "embed", 5.0), ("b2", "embed", 1.0)], "batch string, part string, ms double")
    assert tuple(planners.decomposed(t).first()) == ("embed", 6.0, 2)


def test_drift_classes_are_disjoint(spark):
    schema = "k int, selected_ids array<string>, selected_ranked_ids array<string>, packed array<string>, budget_used int, score double"
    base = [(i, ["a", "b"], ["a", "b"], ["a", "b"], 10, 1.0) for i in range(6)]
    new = [base[0], (1, ["a", "b"], ["a", "b"], ["a", "b"], 10, 2.0), (2, ["a", "c"], ["a", "c"], ["a", "c"], 10, 1.0), (3, ["a", "b"], ["b", "a"], ["a", "b"], 10, 1.0), (4, ["b", "a"], ["b", "a"], ["b", "a"], 10, 1.0), (5, ["a", "b"], ["a", "b"], ["a"], 5, 1.0)]
    got = {r.drift: r.n for r in evaluate.drift(spark.createDataFrame(base, schema), spark.createDataFrame(new, schema), ["k"]).collect()}
    assert got == {"identical": 1, "numeric-only": 1, "selected-set-change": 1, "rank-only": 1, "same-set-different-order": 1, "packed-boundary-change": 1}
    s = spark.createDataFrame([("lru", 0.5, 0.1), ("lfu", 0.5, 0.9)], "policy string, development double, held_out double")
    assert evaluate.best_on_development(s).first().policy == "lfu" and S.numeric_guard(384) > 0
