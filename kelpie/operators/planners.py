"""Choices among measured alternatives: gain gates, skylines, placements, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gain_gate(samples: DataFrame, baseline: str, switched: bool = False) -> DataFrame:
    """(candidate, base_median, median, noise, conservative, threshold, accepted) of each candidate against the baseline.

    ``samples`` has (workload, candidate, ms). Noise is three scaled median deviations of both sides; a gain must exceed it,
    a quarter millisecond and five per cent of the baseline (seven after a switch), with at least five samples.
    """
    med = samples.groupBy("workload", "candidate").agg(F.median("ms").alias("median"), F.count("*").alias("n"))
    dev = samples.join(med, ["workload", "candidate"]).groupBy("workload", "candidate").agg(F.median(F.abs(F.col("ms") - F.col("median"))).alias("mad"))
    both = med.join(dev, ["workload", "candidate"])
    b = both.filter(F.col("candidate") == baseline).select("workload", F.col("median").alias("base_median"), F.col("mad").alias("base_mad"), F.col("n").alias("base_n"))
    j = both.filter(F.col("candidate") != baseline).join(b, "workload")
    noise = 3 * 1.4826 * (F.col("base_mad") + F.col("mad"))
    j = j.withColumn("noise", noise).withColumn("conservative", F.col("base_median") - F.col("median") - F.col("noise"))
    j = j.withColumn("threshold", F.greatest(F.col("noise"), F.lit(0.25), F.col("base_median") * (0.07 if switched else 0.05)))
    ok = (F.col("conservative") > F.col("threshold")) & (F.least("n", "base_n") >= 5)
    return j.select("workload", "candidate", "base_median", "median", "noise", "conservative", "threshold", ok.alias("accepted"))


def skyline(rows: DataFrame, key: str, costs: list[str], group: list[str]) -> DataFrame:
    """Rows that no other row of the group dominates (all costs at most as high, one lower). A null never dominates."""
    other = rows.select(*(F.col(g).alias(f"o_{g}") for g in group), F.col(key).alias("o_key"), *(F.col(c).alias(f"o_{c}") for c in costs))
    same = [F.col(g) == F.col(f"o_{g}") for g in group]
    no_more = [F.coalesce(F.col(f"o_{c}") <= F.col(c), F.col(f"o_{c}").isNull() & F.col(c).isNull()) for c in costs]
    less = [F.coalesce(F.col(f"o_{c}") < F.col(c), F.lit(False)) for c in costs]
    any_less = less[0]
    for x in less[1:]:
        any_less = any_less | x
    return rows.join(other, [*same, F.col(key) != F.col("o_key"), *no_more, any_less], "left_anti")


def select_policy(rows: DataFrame, group: list[str], order: list[Column], eligible: Column) -> DataFrame:
    """The eligible row of each group that comes first in ``order``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.filter(eligible).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def placement(targets: DataFrame, needs: DataFrame) -> DataFrame:
    """Each (need, target): the reasons against it and whether it is the best without any.

    ``targets`` has (target, capacity, p95_ms, mb_per_s, durable), ``needs`` has (need, bytes, max_p95_ms, min_mb_per_s, durable_needed).
    """
    j = needs.join(F.broadcast(targets))  # a list of storage targets
    why = F.filter(
        F.array(
            F.when(F.col("bytes") > F.col("capacity"), "capacity"),
            F.when(F.col("durable_needed") & ~F.col("durable"), "durability"),
            F.when(F.col("p95_ms").isNull() & F.col("mb_per_s").isNull(), "unmeasured"),
            F.when(~(F.coalesce(F.col("p95_ms") <= F.col("max_p95_ms"), F.lit(False)) | F.coalesce(F.col("mb_per_s") >= F.col("min_mb_per_s"), F.lit(False))), "too_slow"),
        ),
        lambda x: x.isNotNull(),
    )
    j = j.withColumn("reasons", F.array_join(why, ","))
    w = Window.partitionBy("need").orderBy((F.col("reasons") != "").cast("int"), F.col("p95_ms").asc_nulls_last(), "target")
    return j.withColumn("chosen", (F.row_number().over(w) == 1) & (F.col("reasons") == "")).select("need", "target", "reasons", "chosen")


def latest_profiles(rows: DataFrame, now: Column, max_age_s: int, keep: int) -> DataFrame:
    """The newest row of each profile that is neither too old nor in quarantine, at most ``keep`` per kind."""
    newest = Window.partitionBy("kind", "profile").orderBy(F.desc("at"))
    p = rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
    until = F.unix_seconds("at") + F.least(F.lit(3600), 60 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(6))))
    held = (F.col("failures") > 0) & (F.unix_seconds(now) < until)
    fresh = F.unix_seconds(now) - F.unix_seconds("at") <= max_age_s
    w = Window.partitionBy("kind").orderBy(F.desc("at"), "profile")
    return p.filter(~held & fresh).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def summary(samples: DataFrame, *group: str) -> DataFrame:
    """Median of each group, null if any sample is unknown."""
    return samples.groupBy(*group).agg(F.when(F.count("ms") == F.count("*"), F.median("ms")).alias("median"), F.count("*").alias("n"))


def predicted_finish(points: DataFrame) -> DataFrame:
    """``points`` with the time until a request ends: p95, queue, and start, compile and staging where these are due; null if unknown."""
    due = lambda flag, cost: F.when(F.col(flag), F.lit(0.0)).otherwise(F.col(cost))
    queue = F.greatest(F.lit(0), "queue_depth") * F.col("p95") / F.greatest(F.lit(1), "concurrency")
    return points.withColumn("finish", F.col("p95") + queue + due("model_warm", "startup") + due("provider_ready", "compile") + due("index_resident", "stage_ms"))


def select_interactive(points: DataFrame, slo_ms: float) -> DataFrame:
    """By workload: the point on the skyline that is predicted to end first within the limit."""
    p = predicted_finish(points)
    return select_policy(p, ["workload"], [F.col("finish"), F.coalesce("cpu_seconds", F.lit(0.0)), F.col("id")], F.coalesce(F.col("finish") <= slo_ms, F.lit(False)))


def same_result(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(…keys, same): whether two results agree in every field, nulls included."""
    j = left.alias("l").join(right.alias("r"), keys, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))
    return j.select(*keys, same.alias("same"))


def joint_choice(candidates: DataFrame, objective: str, reuses: int = 1) -> DataFrame:
    """Candidates with the reasons against each; the best without any is chosen by the objective's order of costs."""
    costs = ["latency_ms", "transfer_ms", "startup_ms", "compile_ms", "throughput", "cpu_seconds"]
    unknown = F.lit(False)
    for c in costs:
        unknown = unknown | F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0)
    why = F.filter(F.array(F.when(~F.col("current"), "stale-profile-or-generation"), F.when(~F.col("semantic_safe"), "semantic-evidence"), F.when(unknown, "unknown-cost")), lambda x: x.isNotNull())
    latency = F.col("latency_ms") + (F.col("transfer_ms") + F.col("startup_ms") + F.col("compile_ms")) / reuses
    order = {"interactive": [F.col("total_ms"), -F.col("throughput")], "bulk": [-F.col("throughput"), F.col("total_ms")], "background": [F.col("cpu_seconds"), F.col("total_ms")]}[objective]
    c = candidates.withColumn("reasons", F.array_join(why, ",")).withColumn("total_ms", latency)
    w = Window.partitionBy("objective").orderBy((F.col("reasons") != "").cast("int"), *order, "id")
    c = c.withColumn("objective", F.lit(objective)).withColumn("chosen", (F.row_number().over(w) == 1) & (F.col("reasons") == ""))
    return c.select("id", "reasons", F.when(F.col("reasons") == "", F.col("total_ms")).alias("total_ms"), "chosen")


def headroom(rows: DataFrame, slo_ms: float) -> DataFrame:
    """What a measured gain leaves below the limit; a report, never a change of policy."""
    return rows.withColumns({"headroom_ms": F.greatest(F.lit(0.0), F.lit(slo_ms) - F.col("optimized_ms")), "dividend_ms": F.col("baseline_ms") - F.col("optimized_ms")})


def score_deltas(reference: DataFrame, candidate: DataFrame, cutoff: int) -> DataFrame:
    """By query: largest score difference of shared rows, rows that change place, and rows that cross the cutoff."""
    r, c = (x.select("query_id", "rowid", F.col("score").alias(f"s_{n}"), F.col("rank").alias(f"k_{n}")) for x, n in ((reference, "r"), (candidate, "c")))
    j = r.join(c, ["query_id", "rowid"], "full_outer")
    inside = lambda n: F.coalesce(F.col(f"k_{n}") <= cutoff, F.lit(False))
    return j.groupBy("query_id").agg(F.max(F.abs(F.col("s_r") - F.col("s_c"))).alias("max_delta"), F.count_if(F.col("k_r") != F.col("k_c")).alias("moved"), F.count_if(inside("r") != inside("c")).alias("crossed"))


def decomposed(timings: DataFrame) -> DataFrame:
    """Total time by part, where a batch's clock counts once however many queries share it (columns batch, part, ms)."""
    return timings.groupBy("batch", "part").agg(F.max("ms").alias("ms")).groupBy("part").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("batches"))
