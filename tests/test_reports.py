"""Reports and checks that no query runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from kelpie.functions import scalars
from kelpie.operators import dense, evaluate, planners, store


def test_admission_needs_gain_recall_and_latency(spark):
    row = lambda any_gold, all_gold, p95: spark.createDataFrame([(any_gold, all_gold, p95)], "any_gold double, all_gold double, p95 double")
    base = row(0.5, 0.4, 100.0)
    for new, want in (((0.52, 0.4, 125.0), (True, True, True)), ((0.505, 0.39, 126.0), (False, False, False)), ((0.6, 0.5, None), (True, True, False))):
        assert tuple(evaluate.admission(base, row(*new)).first()) == want


def test_equal_results_and_score_deltas(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "w", 2)], "k int, f string, g int")
    assert {r.k: r.same for r in planners.same_result(a, b, ["k"], ["f", "g"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    run = lambda rows: spark.createDataFrame(rows, "query_id int, rowid int, score double, rank int")
    got = planners.score_deltas(run([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3)]), run([(1, 1, 0.9, 2), (1, 2, 0.95, 1), (1, 4, 0.1, 3)]), 2).first()
    assert (round(got.max_delta, 9), got.moved, got.crossed) == (0.15, 2, 0)


def test_profiles_that_are_fresh_and_not_held(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    rows = [("cpu", "a", ago(10), 0), ("cpu", "a", ago(5), 1), ("cpu", "b", ago(90), 1), ("cpu", "c", ago(999), 0), ("cpu", "d", ago(20), 0), ("cpu", "e", ago(30), 0), ("gpu", "f", ago(400), 3)]
    df = spark.createDataFrame(rows, "kind string, profile string, at timestamp, failures int")
    assert [r.profile for r in planners.latest_profiles(df, F.lit(now), 500, 2).orderBy("kind", F.desc("at")).collect()] == ["d", "e", "f"]


def test_headroom_units_and_buckets(spark):
    r = planners.headroom(spark.createDataFrame([(50.0, 80.0), (120.0, 130.0)], "optimized_ms double, baseline_ms double"), 100.0).collect()
    assert [(x.headroom_ms, x.dividend_ms) for x in r] == [(50.0, 30.0), (0.0, 10.0)]
    v = spark.createDataFrame([([0.6, 0.8],), ([0.6, 0.9],), ([1.0],)], "v array<double>")
    assert [x[0] for x in v.select(dense.is_unit(F.col("v"), 2)).collect()] == [True, False, False]
    b = spark.createDataFrame([(100.0, 100.0), (399.0, 100.0), (10.0, 100.0)], "f double, b double")
    assert [x[0] for x in b.select(scalars.scale_bucket(F.col("f"), F.col("b"))).collect()] == [0, 1, -4]


def test_a_matrix_needs_every_vector(spark):
    docs = spark.createDataFrame([("s", "a", "t", "x", "", "")], "scope string, id string, text string, speaker string, timestamp string, source string")
    hashed = store.content_hash(docs)
    vectors = hashed.select("scope", "id", "hash").withColumn("vector", F.array(F.lit(1.0)))
    assert dense.matrix(hashed, vectors).count() == 1 and store.content_hash(docs.withColumn("text", F.lit("u"))).first().hash != hashed.first().hash
    with pytest.raises(Exception, match="incomplete"):
        dense.matrix(store.content_hash(docs.withColumn("text", F.lit("u"))), vectors).collect()
