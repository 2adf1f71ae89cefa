"""Costs of packed contexts against full histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RHOS = (0.0, 0.5, 0.9)


def cohort_costs(rows: DataFrame, full: DataFrame, rate: float, cached_rate: float) -> DataFrame:
    """By (mode, budget, rho): tokens, cost where a share rho is billed at the cached rate, cost per query with gold.

    ``rows`` has (scope, mode, budget, budget_used, hits); ``full`` the tokens of each scope's whole history.
    """
    j = rows.join(full, "scope", "left").filter(F.assert_true(F.col("full_tokens").isNotNull(), F.lit("a scope has no full history")).isNull())
    j = j.withColumn("rho", F.explode(F.array(*map(F.lit, RHOS))))
    price = F.col("rho") * cached_rate + (1 - F.col("rho")) * rate
    return j.groupBy("mode", "budget", "rho").agg(
        F.count("*").alias("queries"),
        F.sum("budget_used").alias("tokens"),
        F.avg("budget_used").alias("mean_tokens"),
        F.sum(F.col("budget_used") / 1e6 * price).alias("cost"),
        F.sum(F.col("full_tokens") / 1e6 * price).alias("full_cost"),
        F.count_if(F.col("hits") > 0).alias("with_gold"),
    ).withColumns({"cost_per_gold": F.try_divide("cost", "with_gold"), "full_ratio": F.try_divide("full_cost", "cost")})


def marginal(costs: DataFrame) -> DataFrame:
    """Added cost and added share with gold from one budget to the next, by mode."""
    w = Window.partitionBy("mode").orderBy("budget")
    share = F.col("with_gold") / F.col("queries")
    step = costs.withColumn("share", share).withColumns({"d_cost": F.col("cost") - F.lag("cost").over(w), "d_share": F.col("share") - F.lag("share").over(w), "from_budget": F.lag("budget").over(w)})
    return step.filter("from_budget IS NOT NULL").select("mode", "from_budget", F.col("budget").alias("to_budget"), "d_cost", "d_share", F.when(F.col("d_share") > 0, F.col("d_cost") / (100 * F.col("d_share"))).alias("cost_per_point"))


def evidence(total: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: sums with their denominators, for reports outside."""
    r = rows.agg(F.count("*").alias("queries"), F.sum("hits").alias("gold_found"), F.sum("n_gold").alias("gold_total"), F.sum("budget_used").alias("packed_tokens"))
    return r.withColumn("recall", F.try_divide("gold_found", "gold_total")).crossJoin(total.select("events", "demand_count", "miss_count", "miss_extra_tokens", "avoided_extra_tokens"))
