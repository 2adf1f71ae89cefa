"""Retrieval metrics, cohorts, paired comparison, parity and censuses."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(packed: DataFrame, candidates: DataFrame, gold: DataFrame, selected: str = "selected_ids") -> DataFrame:
    """A row per query with gold: hits, candidate hits, reciprocal rank and nDCG in packed order.

    ``packed`` has (query_id, selected_ids, budget_used), ``candidates`` and ``gold`` have (query_id, id).
    """
    g = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("gold"))
    c = candidates.groupBy("query_id").agg(F.collect_set("id").alias("cand"))
    none = F.array().cast("array<string>")
    j = g.join(packed, "query_id", "left").join(c, "query_id", "left").withColumn("sel", F.coalesce(selected, none)).withColumn("cand", F.coalesce("cand", none))
    at = F.filter(F.transform("sel", lambda x, i: F.when(F.array_contains("gold", x), i + 1)), lambda p: p.isNotNull())
    gain = lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    ideal = F.least(F.size("gold"), F.size("sel"))
    return j.withColumn("at", at).select(
        "query_id",
        F.size("gold").alias("n_gold"),
        F.size("at").alias("hits"),
        F.size(F.array_intersect("gold", "cand")).alias("candidate_hits"),
        F.size("sel").alias("n_selected"),
        F.coalesce("budget_used", F.lit(0)).alias("budget_used"),
        F.when(F.size("at") > 0, 1 / F.element_at("at", 1)).otherwise(0.0).alias("reciprocal_rank"),
        F.when(ideal > 0, gain("at") / gain(F.sequence(F.lit(1), ideal))).otherwise(0.0).alias("ndcg"),
    )


def metrics(rows: DataFrame, *group: str) -> DataFrame:
    """Shares of queries with any and all gold, macro and micro recall, MRR, nDCG, emptiness and budget."""
    return rows.groupBy(*group).agg(
        F.count("*").alias("scorable"),
        F.avg((F.col("hits") > 0).cast("double")).alias("any_gold"),
        F.avg((F.col("hits") == F.col("n_gold")).cast("double")).alias("all_gold"),
        F.avg(F.col("hits") / F.col("n_gold")).alias("macro_recall"),
        F.try_divide(F.sum("hits"), F.sum("n_gold")).alias("micro_recall"),
        F.avg((F.col("candidate_hits") > 0).cast("double")).alias("candidate_any_gold"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
        F.avg((F.col("n_selected") == 0).cast("double")).alias("empty_rate"),
        F.avg("budget_used").alias("mean_budget"),
    )


def percentiles(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Mean and percentiles by all three rules: linear, nearest rank (ceil(q n)) and floor index (int(q (n - 1))).

    Aggregations throughout: the value at the floor index is the largest one up to the linear percentile.
    """
    known = rows.filter(F.col(value).isNotNull())
    first = known.groupBy(*group).agg(
        F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95_nearest")
    )
    line = first.select(*group, F.col("p95").alias("__p"))
    below = (known.join(line, list(group)) if group else known.crossJoin(line)).filter(F.col(value) <= F.col("__p"))
    floor = below.groupBy(*group).agg(F.max(value).alias("p95_floor"))
    return first.join(floor, list(group)) if group else first.crossJoin(floor)


def cohorts(rows: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """``rows`` once for each cohort that takes them: cohorts may overlap."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()]), lambda x: x.isNotNull())
    return rows.withColumn("cohort", F.explode(names))


def census(rows: DataFrame) -> DataFrame:
    """(outcome, n): success, budget_impossible, found_not_packed or candidate_miss."""
    kind = F.when(F.col("hits") > 0, "success").when(F.col("smallest_gold_block") > F.col("budget"), "budget_impossible").when(F.col("candidate_hits") > 0, "found_not_packed").otherwise("candidate_miss")
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def paired(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(…keys, before, after, outcome): win, loss or tie; a key on one side only is an error."""
    b, a = (x.select(*keys, F.col(value).alias(n)) for x, n in ((before, "before"), (after, "after")))
    j = b.join(a, keys, "full_outer")
    j = j.filter(F.assert_true(F.col("before").isNotNull() & F.col("after").isNotNull(), F.lit("paired keys differ")).isNull())
    return j.withColumn("outcome", F.when(F.col("after") > F.col("before"), "win").when(F.col("after") < F.col("before"), "loss").otherwise("tie"))


def bootstrap(pairs: DataFrame, cluster: str, seed: int = 20260907, repeats: int = 2000) -> DataFrame:
    """One row: mean difference and its 95% interval by resampling clusters. Sums per cluster are all that is gathered."""
    sums = pairs.groupBy(cluster).agg(F.sum(F.col("after").cast("double") - F.col("before").cast("double")).alias("d"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in pdf["rows"]:
                cells = [(r["d"], r["n"]) for r in rows]
                rng, means = random.Random(seed), []
                for _ in range(repeats):
                    drawn = [rng.choice(cells) for _ in cells]
                    means.append(sum(d for d, _ in drawn) / sum(n for _, n in drawn))
                means.sort()
                mean = sum(d for d, _ in cells) / sum(n for _, n in cells)
                yield pd.DataFrame([(mean, means[int(0.025 * (repeats - 1))], means[int(0.975 * (repeats - 1))])], columns=["mean", "low", "high"])

    one = sums.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), "d", "n"))).alias("rows"))
    return one.mapInPandas(run, "mean double, low double, high double")


def parity(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str], close: dict[str, float]) -> DataFrame:
    """(field, mismatches, missing_left, missing_right): compare two runs row by row, with tolerances for numbers."""
    j = left.alias("l").join(right.alias("r"), keys, "full_outer")
    both = F.col(f"l.{exact[0]}").isNotNull() & F.col(f"r.{exact[0]}").isNotNull()
    differ = {c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in exact} | {c: ~F.coalesce(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tol, F.col(f"l.{c}").isNull() & F.col(f"r.{c}").isNull()) for c, tol in close.items()}
    fields = F.array(*[F.struct(F.lit(c).alias("field"), d.alias("bad")) for c, d in differ.items()])
    rows = j.select(both.alias("both"), F.col(f"l.{exact[0]}").isNull().alias("no_left"), F.col(f"r.{exact[0]}").isNull().alias("no_right"), F.explode(fields).alias("f"))
    return rows.groupBy(F.col("f.field").alias("field")).agg(
        F.count_if(F.col("both") & F.col("f.bad")).alias("mismatches"), F.count_if("no_left").alias("missing_left"), F.count_if("no_right").alias("missing_right")
    )


def reuse_census(texts: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """One row: inputs, duplicates of earlier inputs, their share and the bytes they would save."""
    sized = texts.select(F.sha2(F.col(text), 256).alias("h"), F.octet_length(text).alias("b"))
    per = sized.groupBy("h").agg(F.count("*").alias("n"), F.max("b").alias("b"))
    return per.agg(F.sum("n").alias("inputs"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("b")).alias("bytes_avoided")).withColumn("duplicate_share", F.try_divide("duplicates", "inputs"))


def outcomes(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """One row: macro mean (nulls skipped), micro ratio, tasks without a result and results without a task."""
    j = tasks.select("task_id", F.lit(True).alias("asked")).join(results.select("task_id", "num", "den", F.lit(True).alias("got")), "task_id", "full_outer")
    return j.agg(
        F.avg(F.try_divide("num", "den")).alias("macro"),
        F.try_divide(F.sum("num"), F.sum("den")).alias("micro"),
        F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("unknown"),
    )


def admission(base: DataFrame, new: DataFrame) -> DataFrame:
    """From two rows of ``metrics`` (with p95): is the gain at least one point, all-gold no worse, and p95 within 1.25?"""
    b, n = base.select([F.col(c).alias(f"b_{c}") for c in base.columns]), new
    return b.crossJoin(n).select(
        (F.col("any_gold") - F.col("b_any_gold") >= 0.01).alias("gain"),
        (F.col("all_gold") >= F.col("b_all_gold")).alias("all_gold_kept"),
        F.coalesce(F.col("p95") <= 1.25 * F.col("b_p95"), F.lit(False)).alias("latency_kept"),
    )


def drift(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(drift, n): each pair of rows in exactly one class, from identical to a change of the selected set.

    Rows have selected_ids, selected_ranked_ids, packed (arrays), budget_used and score, and may have diagnostics, which tell of a run
    but not of its result.
    """
    j = reference.alias("l").join(candidate.alias("r"), keys, "full_outer")
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    both = F.col("l.budget_used").isNotNull() & F.col("r.budget_used").isNotNull()
    told = same("diagnostics") if "diagnostics" in reference.columns and "diagnostics" in candidate.columns else F.lit(True)
    kind = (
        F.when(~both, "other-semantic-change")
        .when(same("selected_ids") & same("selected_ranked_ids") & same("packed") & same("budget_used"), F.when(~same("score"), "numeric-only").when(~told, "diagnostic-only").otherwise("identical"))
        .when(as_set("l.selected_ids") != as_set("r.selected_ids"), "selected-set-change")
        .when(same("selected_ids") & same("packed") & same("budget_used"), "rank-only")
        .when(same("budget_used") & (F.array_sort("l.packed") == F.array_sort("r.packed")), "same-set-different-order")
        .when(~same("packed") | ~same("budget_used"), "packed-boundary-change")
        .otherwise("other-semantic-change")
    )
    return j.groupBy(kind.alias("drift")).agg(F.count("*").alias("n"))


def best_on_development(scores: DataFrame) -> DataFrame:
    """Of (policy, development, held_out): the policy best on development, ties by name; its held-out rate is the result."""
    return scores.orderBy(F.desc("development"), "policy").limit(1)
