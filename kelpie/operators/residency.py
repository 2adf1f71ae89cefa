"""Shadow residency plans: values from telemetry, guards, and an exact selection under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of one exact plan.
MAX_UNITS, MAX_ITEMS = 100_000, 1_024


def values(entries: DataFrame, item_rows: DataFrame, n_tasks: int, horizon: int = 20) -> DataFrame:
    """Each entry's expected saving, carrying cost and net value over ``horizon`` tasks, and the basis of its penalty."""
    t = item_rows.select("item_id", "needs", "misses", "avoidable_misses", "avoidable_extra_tokens", F.col("n_stale_resident_failure").alias("stale"), F.size("demand_task_ids").alias("need_tasks"))
    e = entries.join(t, entries["id"] == t["item_id"], "left").fillna(0, ["needs", "misses", "avoidable_misses", "avoidable_extra_tokens", "stale", "need_tasks"])
    need = F.coalesce(F.try_divide("need_tasks", F.lit(n_tasks)), F.lit(0.0))
    rate = F.coalesce(F.try_divide("avoidable_misses", "needs"), F.lit(0.0))
    penalty = F.coalesce(F.col("miss_penalty_tokens"), F.try_divide("avoidable_extra_tokens", "avoidable_misses"))
    by_catalog = F.col("miss_penalty_tokens").isNotNull()
    basis = F.when(by_catalog, "catalog_counterfactual").when(F.col("avoidable_misses") > 0, "observed_avoidable_miss_average").otherwise("unknown")
    resident = F.col("tier") == "T0"
    expected = F.when(penalty.isNull(), None).when(resident & by_catalog, need * horizon).otherwise(need * horizon * rate)
    return e.select(
        "id", "tier", "pinned", F.col("resident_units").cast("long").alias("units"), "stale",
        basis.alias("basis"), penalty.alias("penalty"), expected.alias("expected_misses"),
        (expected * penalty).alias("saved"), (F.col("resident_units") * horizon).cast("long").alias("carry"),
        (expected * penalty - F.col("resident_units") * horizon).alias("net"), (resident & penalty.isNull()).alias("uncertain"),
    )


def guarded(rows: DataFrame, complete_coverage: bool = False) -> DataFrame:
    """``rows`` with a role: blocked, fixed, candidate or out, and the reason to review if there is one."""
    resident = F.col("tier") == "T0"
    role = (
        F.when(F.col("stale") > 0, "blocked")
        .when(resident & (F.col("pinned") | F.col("uncertain")), "fixed")
        .when(F.col("net") > 0, "candidate")
        .when(resident & F.lit(not complete_coverage), "fixed")
        .otherwise("out")
    )
    review = (
        F.when(F.col("stale") > 0, "stale_resident_failure")
        .when(resident & ~F.col("pinned") & F.col("uncertain"), "counterfactual_miss_cost_unknown")
        .when((role == "fixed") & ~F.col("pinned"), "telemetry_coverage_incomplete")
    )
    return rows.withColumn("role", role).withColumn("review", review)


def best_subset(items: list[tuple[str, int, float, float, int]], capacity: int) -> list[str]:
    """Ids of the best 0/1 selection of (id, units, value, activity, priority) within ``capacity``.

    Better is: more value, then activity, then priority, then fewer units, then the smaller list of ids.
    """
    if len(items) > MAX_ITEMS or capacity > MAX_UNITS:
        raise ValueError("an exact plan takes at most 1,024 items and 100,000 units")
    items = sorted(i for i in items if i[1] <= capacity)
    best: dict[int, tuple[float, float, int, list[str]]] = {0: (0.0, 0.0, 0, [])}

    def better(x, xu, y, yu) -> bool:
        for a, b in zip(x[:2], y[:2], strict=True):
            if abs(a - b) > 1e-12:
                return a > b
        if x[2] != y[2]:
            return x[2] > y[2]
        return xu < yu if xu != yu else x[3] < y[3]

    for name, units, value, act, priority in items:
        for used, (v, a, p, ids) in list(best.items()):
            total = used + units
            new = (v + value, a + act, p + priority, [*ids, name])
            if total <= capacity and (total not in best or better(new, total, best[total], total)):
                best[total] = new
    top = 0
    for used in best:
        if better(best[used], used, best[top], top):
            top = used
    return best[top][3]


def knapsack(candidates: DataFrame, capacity: DataFrame, group: str) -> DataFrame:
    """(group, selected, value): the exact selection of each group's candidates (id, units, net) within its capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, cap, items in zip(pdf[group], pdf["capacity"], pdf["items"], strict=True):
                chosen = best_subset([(i["id"], int(i["units"]), i["net"], 0.0, 0) for i in items], int(cap))
                worth = {i["id"]: i["net"] for i in items}
                out.append((g, ",".join(sorted(chosen)), float(np.sum([worth[c] for c in chosen]))))
            yield pd.DataFrame(out, columns=[group, "selected", "value"])

    listed = candidates.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("id", "units", "net"))).alias("items"))
    return listed.join(capacity, group).mapInPandas(run, f"{group} string, selected string, value double")


def shadow_plan(rows: DataFrame, budget: int, n_tasks: int, min_tasks: int = 20) -> DataFrame:
    """One row: status, and selected, admitted, evicted and retained ids. Nothing is ever applied."""
    g = guarded(rows).withColumn("plan", F.lit("all"))
    fixed = g.filter("role = 'fixed'").groupBy("plan").agg(F.sum("units").alias("fixed_units"), F.array_sort(F.collect_list("id")).alias("fixed"))
    held = g.groupBy("plan").agg(F.array_sort(F.collect_list(F.when(F.col("tier") == "T0", F.col("id")))).alias("current"))
    base = held.join(fixed, "plan", "left").withColumn("fixed_units", F.coalesce("fixed_units", F.lit(0))).withColumn("fixed", F.coalesce("fixed", F.array().cast("array<string>")))
    room = base.select("plan", F.greatest(F.lit(0), F.lit(budget) - F.col("fixed_units")).alias("capacity"))
    chosen = knapsack(g.filter("role = 'candidate'"), room, "plan")
    p = base.join(chosen, "plan", "left").withColumn("extra", F.filter(F.split(F.coalesce("selected", F.lit("")), ","), lambda x: x != "")).drop("selected")
    selected = F.array_sort(F.concat("fixed", "extra"))
    status = F.when(F.col("fixed_units") > budget, "PROTECTED_OVER_BUDGET").when(F.lit(n_tasks < min_tasks), "INSUFFICIENT_TELEMETRY").otherwise("OK")
    ok, text = status == "OK", lambda a: F.array_join(F.array_sort(a), ",")
    return p.select(
        status.alias("status"),
        text(F.when(ok, selected).otherwise(F.col("current"))).alias("selected"),
        text(F.when(ok, F.array_except(selected, "current")).otherwise(F.array().cast("array<string>"))).alias("admit"),
        text(F.when(ok, F.array_except("current", selected)).otherwise(F.array().cast("array<string>"))).alias("evict"),
        text(F.when(ok, F.array_intersect(selected, "current")).otherwise(F.col("current"))).alias("retain"),
        text(selected).alias("provisional_selected"),
    )
