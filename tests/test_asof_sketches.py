"""As-of joins against a plain search, and sketches that merge, against exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from kelpie.operators import asof, sketches
from kelpie.sources import scratch


def plain(left, right, strict, tolerance):
    out = []
    for i, k, t in left:
        best = None
        for k2, t2, v in right:
            if None not in (k, t, k2, t2) and k == k2 and (t2 < t or (t2 == t and not strict)):
                best = max(best or (t2, v), (t2, v), key=lambda x: (x[0], x[1]))
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        out.append((i, k, t, *(best or (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("strict", "tolerance"), [(False, None), (True, None), (False, 3)])
def test_as_of(spark, strict, tolerance):
    rng = random.Random(8)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)] + [(400 + i, "moment", 7) for i in range(60)] + [(900, "early", 1)]
    right = [(key(), rng.choice([None, *range(0, 60, 4)]), rng.randrange(99)) for _ in range(60)] + [("moment", 7, 5), ("moment", 7, 4), ("early", 2, 1), ("unasked", 1, 1)]
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, id int").repartition(2)
    got = asof.as_of(a, b, "k", "t", strict=strict, tolerance=None if tolerance is None else F.lit(tolerance))
    assert got.columns == ["id", "k", "t", "t_right", "id_right"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(left, right, strict, tolerance)


def test_as_of_of_empty_sides(spark):
    a, none = spark.createDataFrame([(1, "x", 2)], "id int, k string, t int"), spark.createDataFrame([], "k string, t int, v int")
    assert [tuple(r) for r in asof.as_of(a, none, "k", "t").collect()] == [(1, "x", 2, None, None)]
    assert asof.as_of(a.limit(0), none, "k", "t").count() == 0


EVENTS = "event_id string, task_id string, kind string, item_id string, extra_tokens bigint, day date"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, task_id string, kind string, item_id string, extra_tokens bigint, day string").withColumn("day", F.to_date("day"))


def test_days_merge_and_a_day_is_replaced_as_a_whole(spark):
    path = scratch.folder(spark)
    kinds = ["resident_hit", "resident_miss", "prefetch", "hard_miss"]
    rows = [(f"e{k}", f"t{k % 37}", kinds[k % 4], f"i{k % 3}" if k % 2 else "hot", k, f"2024-01-0{1 + k % 5}") for k in range(600)]
    df = events(spark, rows)
    sketches.update(df.filter("day <= DATE '2024-01-03'"), path)
    sketches.update(df.filter("day = DATE '2024-01-03'"), path)  # delivered again: the same day, not twice
    sketches.update(df.filter("day > DATE '2024-01-03'"), path)
    demand = F.col("kind").isin("resident_hit", "resident_miss", "hard_miss")
    exact = df.groupBy("item_id").agg(F.count_if(demand).alias("needs"), F.count_distinct("task_id").alias("tasks"), F.count_distinct(F.when(demand, F.col("task_id"))).alias("demand_tasks"), F.sum(F.when(F.col("kind").isin("resident_miss", "hard_miss"), F.col("extra_tokens")).otherwise(0)).alias("miss_extra_tokens"))
    got = sketches.rolled(spark, path, ["item_id"]).select(*exact.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))
    part = sketches.rolled(spark, path, ["item_id"], "2024-01-02", "2024-01-03").agg(F.sum("needs")).first()[0]
    assert part == df.filter("day BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'").filter(demand).count()
    whole = sketches.rolled(spark, path, []).first()
    assert whole.tasks == 37 and whole.needs == df.filter(demand).count()


def test_shared_tasks_of_two_items(spark):
    path = scratch.folder(spark)
    rows = [(f"a{k}", f"t{k}", "resident_hit", "x", 0, "2024-01-01") for k in range(50)] + [(f"b{k}", f"t{k}", "hard_miss", "y", 0, "2024-01-02") for k in range(30, 90)] + [("c", "t1", "prefetch", "z", 0, "2024-01-02")]
    sketches.update(events(spark, rows), path)
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "x")], "seed_id string, cand_id string")
    got = {(r.seed_id, r.cand_id): (r.support, r.confidence) for r in sketches.shared_tasks(spark, path, pairs).collect()}
    assert got == {("x", "y"): (20, 0.4), ("y", "x"): (20, 20 / 60), ("x", "z"): (0, 0.0), ("x", "x"): (50, 1.0)}


def test_the_error_of_large_sets_is_within_its_bound(spark):
    path = scratch.folder(spark)
    df = spark.range(60_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 40_000).alias("task_id"), F.lit("resident_hit").alias("kind"), F.lit("hot").alias("item_id"), F.lit(1).cast("long").alias("extra_tokens"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"))
    sketches.update(df, path)
    r = sketches.rolled(spark, path, ["item_id"]).first()
    assert abs(r.tasks - 40_000) <= 3 * sketches.relative_error() * 40_000 and r.needs == 60_000 and not r.exact
