"""Roll-ups of usage telemetry. Rates with a zero denominator are null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import policy

# The kinds of telemetry.
KINDS = ["hard_miss", "planned_retrieval", "prefetch", "resident_hit", "resident_miss", "stale_resident_failure"]
DEMAND = ["resident_hit", "resident_miss", "hard_miss"]
MISS = ["resident_miss", "hard_miss"]


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _sum(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def checked(events: DataFrame) -> DataFrame:
    """``events``, failing at run time on an unknown kind, a negative cost, or a prefetch without ``used``."""
    bad = ~F.col("kind").isin(*KINDS) | (F.col("extra_tokens") < 0) | (F.col("extra_cost_usd") < 0) | (F.col("extra_latency_ms") < 0)
    bad |= (F.col("kind") == "prefetch") & F.col("used").isNull()
    bad |= F.col("item_id").isNull() & (F.col("kind") != "stale_resident_failure")
    return events.filter(F.assert_true(~bad, F.lit("invalid telemetry event")).isNull())


def duplicate_ids(events: DataFrame) -> DataFrame:
    return events.groupBy("event_id").count().filter("count > 1")


def totals(events: DataFrame) -> DataFrame:
    """One row over all events."""
    demand, miss, pre = _is(*DEMAND), _is(*MISS), _is("prefetch")
    avoidable, used = miss & F.col("avoidable"), pre & F.col("used")
    base = events.agg(
        F.count("*").alias("events"),
        F.count_distinct("task_id").alias("tasks"),
        F.count_distinct(F.when(demand, F.col("task_id"))).alias("demand_tasks"),
        *(F.count_if(_is(k)).alias(f"n_{k}") for k in KINDS),
        F.count_if(demand).alias("demand_count"),
        F.count_if(miss).alias("miss_count"),
        F.count_if(avoidable).alias("avoidable_miss_count"),
        _sum(miss, "extra_tokens").alias("miss_extra_tokens"),
        _sum(miss, "extra_tool_calls").alias("miss_extra_tool_calls"),
        _sum(miss, "extra_latency_ms").alias("miss_extra_latency_ms"),
        _sum(miss, "extra_cost_usd").alias("miss_extra_cost_usd"),
        _sum(avoidable, "extra_tokens").alias("avoidable_extra_tokens"),
        F.count_if(used).alias("prefetch_used"),
        F.count_if(pre & F.col("avoided_miss").isNotNull()).alias("known_avoided_labels"),
        F.count_if(pre & F.col("avoided_miss")).alias("avoided_misses"),
        _sum(pre, "extra_tokens").alias("injected_tokens"),
        _sum(pre & ~F.col("used"), "extra_tokens").alias("unused_injected_tokens"),
        _sum(pre, "avoided_extra_tokens").alias("avoided_extra_tokens"),
    )
    return base.select(
        "*",
        F.try_divide("miss_count", "demand_count").alias("resident_miss_rate"),
        F.try_divide("n_hard_miss", "demand_count").alias("hard_miss_rate"),
        F.try_divide("avoidable_miss_count", "demand_count").alias("avoidable_miss_rate"),
        F.try_divide("prefetch_used", "n_prefetch").alias("prefetch_accuracy"),
        F.try_divide(F.col("avoided_misses"), F.col("avoidable_miss_count") + F.col("avoided_misses")).alias("prefetch_coverage"),
        (F.col("avoided_extra_tokens") - F.col("injected_tokens")).alias("prefetch_net_tokens"),
    )


def items(events: DataFrame) -> DataFrame:
    """A row per item, with its distinct tasks."""
    demand, miss, pre = _is(*DEMAND), _is(*MISS), _is("prefetch")
    avoidable, used = miss & F.col("avoidable"), pre & F.col("used")
    base = events.filter("item_id IS NOT NULL").groupBy("item_id").agg(
        *(F.count_if(_is(k)).alias(f"n_{k}") for k in KINDS),
        F.count_if(demand).alias("needs"),
        F.count_if(miss).alias("misses"),
        F.count_if(avoidable).alias("avoidable_misses"),
        _sum(miss, "extra_tokens").alias("miss_extra_tokens"),
        _sum(avoidable, "extra_tokens").alias("avoidable_extra_tokens"),
        F.count_if(used).alias("prefetch_used"),
        F.count_if(pre & F.col("avoided_miss")).alias("prefetch_avoided_misses"),
        _sum(pre, "extra_tokens").alias("prefetch_tokens"),
        _sum(pre, "avoided_extra_tokens").alias("prefetch_avoided_tokens"),
        F.array_sort(F.collect_set(F.when(demand | used, F.col("task_id")))).alias("task_ids"),
        F.array_sort(F.collect_set(F.when(demand, F.col("task_id")))).alias("demand_task_ids"),
    )
    tasks = events.agg(F.count_distinct(F.when(demand, F.col("task_id"))).alias("all_demand_tasks"))  # one row
    return base.crossJoin(tasks).select(
        *base.columns,
        F.try_divide("misses", "needs").alias("miss_rate"),
        F.try_divide("avoidable_misses", "needs").alias("avoidable_miss_rate"),
        F.try_divide(F.size("demand_task_ids"), F.col("all_demand_tasks")).alias("need_task_rate"),
        F.try_divide("avoidable_extra_tokens", "avoidable_misses").alias("avg_avoidable_extra_tokens"),
        F.try_divide("prefetch_used", "n_prefetch").alias("prefetch_accuracy"),
        F.try_divide(F.col("prefetch_avoided_misses"), F.col("avoidable_misses") + F.col("prefetch_avoided_misses")).alias("prefetch_coverage"),
        (F.col("prefetch_avoided_tokens") - F.col("prefetch_tokens")).alias("prefetch_net_tokens"),
    )


def low_support(item_rows: DataFrame, min_demands: int) -> DataFrame:
    """``item_rows`` with the evidence of items below ``min_demands`` set to zero."""
    low = F.col("needs") < min_demands
    zeroed = ["needs", "misses", "avoidable_misses", "miss_extra_tokens", "avoidable_extra_tokens"]
    out = item_rows.withColumns({"suppressed": low} | {c: F.when(low, 0).otherwise(F.col(c)) for c in zeroed})
    return out.withColumn("demand_task_ids", F.when(low, F.array().cast("array<string>")).otherwise(F.col("demand_task_ids")))


def budget_step(
    total: DataFrame, budget: int, pressure: float, *, least: int, most: int, step: int, min_demands: int = 20,
    miss_target: float = 0.10, pressure_target: float = 0.80, miss_weight: float = 1.0, pressure_weight: float = 1.0, pollution_weight: float = 0.5, hysteresis: float = 0.05,
) -> DataFrame:
    """From the row of ``totals``: grow, shrink, hold or hold_at_bound, and the budget suggested."""
    pollution = F.coalesce(F.try_divide(F.col("n_prefetch") - F.col("prefetch_used"), F.col("n_prefetch")), F.lit(0.0))
    stale = F.when(F.col("demand_count") > 0, F.col("n_stale_resident_failure") / F.col("demand_count")).when(F.col("n_stale_resident_failure") > 0, 1.0).otherwise(0.0)
    grow = F.lit(miss_weight) * F.greatest(F.lit(0.0), F.coalesce("avoidable_miss_rate", F.lit(0.0)) - miss_target)
    shrink = F.lit(pressure_weight) * F.greatest(F.lit(0.0), F.lit(pressure - pressure_target)) + F.lit(pollution_weight) * (pollution + stale)
    t = total.select("demand_count", pollution.alias("pollution"), stale.alias("stale_rate"), grow.alias("grow_signal"), shrink.alias("shrink_signal"))
    gap = F.col("grow_signal") - F.col("shrink_signal")
    want = F.when(F.col("demand_count") < min_demands, "hold").when(gap > hysteresis, "grow").when(gap < -hysteresis, "shrink").otherwise("hold")
    moved = F.when(want == "grow", F.least(F.lit(most), F.lit(budget + step))).when(want == "shrink", F.greatest(F.lit(least), F.lit(budget - step))).otherwise(F.lit(budget))
    return t.select("*", F.when((want != "hold") & (moved == budget), "hold_at_bound").otherwise(want).alias("action"), moved.cast("long").alias("suggested_budget"))


def prefetch_plan(item_rows: DataFrame, seeds: DataFrame, min_support: int = 2, min_confidence: float = 0.5, k: int | None = 20, entries: DataFrame | None = None, now: Column | None = None, tiers: tuple[str, ...] = ("T1",)) -> DataFrame:
    """Items that share demand tasks with seed items: support, confidence and best seed, best ``k`` first.

    With ``entries``, seeds are current entries that were asked for in ``min_support`` tasks at least; candidates are the current
    entries of ``tiers`` with a safe locator, and an entry's own penalty goes before the one observed.
    """
    item_rows, asked = item_rows.withColumn("own_penalty", F.lit(None).cast("double")), seeds.select("item_id")
    seeds = asked
    if entries is not None:
        held = entries.filter(policy.current(now))
        own = held.filter(F.col("tier").isin(*tiers) & S.entry_locator(F.col("locator"), F.col("store")).isNotNull())
        known = held.select(F.col("id").alias("item_id"), F.col("miss_penalty_tokens").cast("double").alias("own_penalty"))
        allowed = own.select(F.col("id").alias("item_id")).join(asked, "item_id", "left_anti").unionByName(asked)
        item_rows = item_rows.drop("own_penalty").join(known, "item_id").join(allowed, "item_id", "left_semi")
        seeds = item_rows.filter(F.size("demand_task_ids") >= min_support).join(asked, "item_id", "left_semi").select("item_id")
    task = item_rows.select("item_id", F.explode("demand_task_ids").alias("task_id"))
    seed_tasks = task.join(seeds.select("item_id"), "item_id", "left_semi")
    size = seed_tasks.groupBy("item_id").agg(F.count("*").alias("seed_tasks")).withColumnRenamed("item_id", "seed_id")
    other = task.join(asked, "item_id", "left_anti").withColumnRenamed("item_id", "cand_id")
    shared = seed_tasks.withColumnRenamed("item_id", "seed_id").join(other, "task_id").groupBy("seed_id", "cand_id").agg(F.count("*").alias("support"))
    scored = shared.join(size, "seed_id").withColumn("confidence", F.col("support") / F.col("seed_tasks")).filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    best = scored.groupBy("cand_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "seed_id")).alias("b"))
    penalty = item_rows.select(F.col("item_id").alias("cand_id"), F.coalesce("own_penalty", "avg_avoidable_extra_tokens", F.lit(-1.0)).alias("penalty"))
    rows = best.join(penalty, "cand_id").select(F.col("cand_id").alias("item_id"), F.col("b.seed_id").alias("seed_id"), (-F.col("b.c")).alias("confidence"), (-F.col("b.s")).alias("support"), "penalty")
    return rows.orderBy(F.desc("confidence"), F.desc("support"), F.desc("penalty"), "item_id").limit(k) if k else rows
