"""Metric cubes: levels, legacy protocols, and what makes a cube invalid."""

import pytest
from pyspark.sql import functions as F

from kelpie.operators import cubes

LEGACY = "mode string, budget int, category int, evidence_count int, fully_resolved boolean, hits int, selected_count int, budget_used int, total_ms double"


def rows(spark, change=()):
    out = [[m, b, k % 5 + 1, k % 3, k % 4 != 1, min(k % 3, (b // 300 + k) % 3), k % 2, b - k, float(k)] for m in ("literal", "sparse") for b in (300, 600) for k in range(20)]
    for at, column, value in change:
        out[at][column] = value
    return spark.createDataFrame([tuple(r) for r in out], LEGACY)


def test_every_level_equals_its_rows(spark):
    legacy = rows(spark)
    cells = {(r.mode, r.budget, r.category): r for r in cubes.checked(cubes.cube(cubes.projected(legacy, "locomo")), ["literal", "sparse"], [300, 600]).collect()}
    plain = [r.asDict() for r in legacy.collect()]
    assert len(cells) == 2 * 2 * 5 + 4 + 2 + 1
    for (mode, budget, category), got in cells.items():
        own = [r for r in plain if mode in (None, r["mode"]) and budget in (None, r["budget"]) and category in (None, r["category"])]
        ok = [r for r in own if r["evidence_count"] and r["fully_resolved"] and r["category"] != 5]
        assert (got.tasks, got.scorable, got.no_gold, got.unresolved, got.diagnostic_only) == (len(own), len(ok), sum(not r["evidence_count"] for r in own), sum(not r["fully_resolved"] for r in own), sum(r["category"] == 5 for r in own))
        assert got.hits == sum(r["hits"] for r in ok) and got.gold == sum(r["evidence_count"] for r in ok)
        if ok:
            assert got.macro_evidence_recall == pytest.approx(sum(r["hits"] / r["evidence_count"] for r in ok) / len(ok)) and got.any_gold_hit_rate == pytest.approx(sum(r["hits"] > 0 for r in ok) / len(ok))
        else:
            assert got.macro_evidence_recall is None and got.micro_evidence_recall is None
        assert got.mean_budget_used == pytest.approx(sum(r["budget_used"] for r in own) / len(own)) and got.level == {3: 7, 2: 3, 1: 1, 0: 0}[[mode, budget, category].count(None)]


def test_levels_are_told_by_number_not_by_nulls(spark):
    legacy = rows(spark).withColumn("category", F.when(F.col("category") != 2, F.col("category")))
    cells = cubes.cube(cubes.projected(legacy, "locomo"))
    assert cells.filter("mode = 'sparse' AND budget = 300 AND category IS NULL").select("level").distinct().count() == 2
    assert {r.level: r["count"] for r in cells.groupBy("level").count().collect()} == {0: 20, 1: 4, 3: 2, 7: 1}


def test_the_session_protocol(spark):
    df = spark.createDataFrame([("m", 1, 5, 2, 2, 1, 3, 9, 1.0, 0), ("m", 1, 1, 2, 1, 1, 3, 9, 2.0, None), ("m", 1, 1, 0, 0, 0, 0, 0, 3.0, 0)], "mode string, budget int, category int, gold_sessions int, resolved_gold int, hits int, selected_count int, budget_used int, total_ms double, packed_selected_count int")
    got = cubes.projected(df, "longmemeval-s").collect()
    assert [(r.resolved, r.diagnostic_only, r.scorable, r.packed_count, r.parent_locator_hits) for r in got] == [(True, False, True, 0, 1), (False, False, False, 3, 1), (True, False, False, 0, 0)]


def test_cubes_that_are_not_whole_fail(spark):
    good = cubes.cube(cubes.projected(rows(spark), "locomo"))
    for cells, modes, message in (
        (good.filter("NOT (level = 0 AND category = 1)"), None, "does not add up"),
        (good.withColumn("hits", F.when(F.col("level") == 3, F.col("hits") + 1).otherwise(F.col("hits"))), None, "does not add up"),
        (good, ["literal"], "denominators or keys"),
        (cubes.cube(cubes.projected(rows(spark).filter("NOT (mode = 'sparse' AND budget = 300 AND total_ms = 3)"), "locomo")), None, "denominators or keys"),
    ):
        with pytest.raises(Exception, match=message):
            cubes.checked(cells, modes, [300, 600] if modes else None).collect()


def test_an_empty_run(spark):
    cells = cubes.cube(cubes.projected(rows(spark).limit(0), "locomo"))
    assert [(r.level, r.tasks) for r in cubes.checked(cells).collect()] in ([], [(7, 0)])
