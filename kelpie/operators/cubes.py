"""Metrics of runs at every level of a cube: by mode, budget and category, in one grouping-set aggregation that checks itself.

Rows of either legacy protocol are projected to shared columns first; then ``cube`` aggregates each of its levels from the same
rows, marked by ``level`` (the number of ``grouping_id``), so a null key is told from a total. ``checked`` asserts that the counters of
every level add up to those above it and that each configuration of mode and budget was asked the same questions; a cube that
is not whole fails at run time instead of giving rates over other denominators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["mode", "budget", "category"]
#: Levels by what is summed away: configurations and categories, configurations, modes, all.
SETS = [["mode", "budget", "category"], ["mode", "budget"], ["mode"], []]
COUNTERS = ["tasks", "scorable", "no_gold", "unresolved", "diagnostic_only", "hits", "gold"]


def projected(rows: DataFrame, benchmark: str) -> DataFrame:
    """Legacy rows with the columns that all protocols share.

    The session protocol (``longmemeval-s``) has gold_sessions and resolved_gold; the other one evidence_count, fully_resolved and
    category, whose fifth is diagnostic only. Optional: parent_locator_hits and packed_selected_count.
    """
    sessions = benchmark == "longmemeval-s"
    gold = F.col("gold_sessions" if sessions else "evidence_count")
    resolved = F.col("resolved_gold") == gold if sessions else F.col("fully_resolved")
    diagnostic = F.lit(False) if sessions else F.coalesce(F.col("category") == 5, F.lit(False))

    def either(first: str, second: str) -> Column:
        return F.coalesce(first, second) if first in rows.columns else F.col(second)

    return rows.select(
        *(F.col(k) for k in KEYS),
        gold.alias("gold_count"),
        resolved.alias("resolved"),
        diagnostic.alias("diagnostic_only"),
        ((gold > 0) & resolved & ~diagnostic).alias("scorable"),
        "hits",
        either("parent_locator_hits", "hits").alias("parent_locator_hits"),
        either("packed_selected_count", "selected_count").alias("packed_count"),
        "budget_used",
        F.col("total_ms").cast("double").alias("latency_ms"),
    )


def cube(rows: DataFrame) -> DataFrame:
    """A row for each member of each level of SETS: counters, rates over scorable rows, budgets and latencies."""
    scorable = F.col("scorable")
    of = lambda c: F.when(scorable, c)
    level = F.grouping_id(*KEYS).cast("int").alias("level")
    return rows.groupingSets([[F.col(k) for k in s] for s in SETS], *KEYS).agg(
        level,
        F.count("*").alias("tasks"),
        F.count_if(scorable).alias("scorable"),
        F.count_if(F.col("gold_count") == 0).alias("no_gold"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if("diagnostic_only").alias("diagnostic_only"),
        F.coalesce(F.sum(of(F.col("hits"))), F.lit(0)).cast("long").alias("hits"),
        F.coalesce(F.sum(of(F.col("gold_count"))), F.lit(0)).cast("long").alias("gold"),
        F.avg(of((F.col("hits") > 0).cast("double"))).alias("any_gold_hit_rate"),
        F.avg(of((F.col("hits") == F.col("gold_count")).cast("double"))).alias("all_gold_hit_rate"),
        F.avg(of(F.col("hits") / F.col("gold_count"))).alias("macro_evidence_recall"),
        F.try_divide(F.sum(of(F.col("hits"))), F.sum(of(F.col("gold_count")))).alias("micro_evidence_recall"),
        F.avg(of((F.col("parent_locator_hits") > 0).cast("double"))).alias("parent_locator_coverage"),
        F.avg((F.col("packed_count") == 0).cast("double")).alias("empty_context_rate"),
        F.avg("budget_used").alias("mean_budget_used"),
        *(F.percentile("latency_ms", F.lit(q)).alias(f"latency_p{round(100 * q)}") for q in (0.5, 0.95, 0.99)),
    )


def checked(cells: DataFrame, modes: list[str] | None = None, budgets: list[int] | None = None) -> DataFrame:
    """``cells``, failing at run time unless every level adds up and every configuration has the same tasks.

    With ``modes`` and ``budgets`` the configurations must be exactly their pairs. The check needs two rows for each level.
    """
    sums = cells.groupBy("level").agg(*(F.sum(c).alias(c) for c in COUNTERS)).agg(*(F.count_distinct(c).alias(c) for c in COUNTERS))
    configs = cells.filter("level = 1").agg(
        F.count_distinct("tasks").alias("sizes"), F.count_if((F.col("scorable") < 0) | (F.col("scorable") > F.col("tasks"))).alias("wrong"), F.array_sort(F.collect_set(F.concat_ws("@", "mode", "budget"))).alias("names")
    )
    good = (F.col("sizes") <= 1) & (F.col("wrong") == 0)
    if modes is not None and budgets is not None:
        good &= F.col("names") == F.array_sort(F.array(*(F.lit(f"{m}@{b}") for m in modes for b in budgets)))
    added = F.lit(True)
    for c in COUNTERS:
        added &= F.col(c) <= 1
    verdict = sums.select(added.alias("added")).crossJoin(configs.select(good.alias("good")))  # one row each
    both = cells.crossJoin(F.broadcast(verdict))
    ok = F.assert_true(F.col("added"), F.lit("a level of the cube does not add up")).isNull() & F.assert_true(F.col("good"), F.lit("configurations differ in their denominators or keys")).isNull()
    return both.filter(ok).select(*cells.columns)
