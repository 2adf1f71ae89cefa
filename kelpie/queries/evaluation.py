"""Queries over retrieval runs, costs and measured alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cubes, economics, evaluate, lexical, planners, telemetry
from ..plans import recall as R
from ..sources import driver as D
from ..sources import scratch
from .memory import EVENTS, TOTALS
from .retrieval import ASKED, CORPUS, HELD, _asked, _corpus, bm25_sql

QUERIES, SQL = {}, {}
BUDGETS = (5, 10)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The best ten documents of each question, and its gold documents."""
    found = lexical.bm25(_corpus(spark, sf_dir), _asked(spark, sf_dir, "corpus"), [("text", 1.0), ("meta", 0.0)], "tokens", 10)
    return found.select("query_id", "id", "rank"), R.gold(D.articles(spark, sf_dir), D.questions(spark, sf_dir))


def _judged(found: DataFrame, gold: DataFrame, selected: int) -> DataFrame:
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= selected, F.struct("rank", "id")))), lambda x: x["id"])
    packed = found.groupBy("query_id").agg(first.alias("selected_ids"), F.count_if(F.col("rank") <= selected).alias("budget_used"))
    return evaluate.judged(packed, found.select("query_id", "id"), gold)


def _run(spark: SparkSession, sf_dir: str, selected: int) -> DataFrame:
    """Judged rows of a literal run: candidates are the best ten documents, the first ``selected`` are packed."""
    found, gold = _found(spark, sf_dir)
    return _judged(scratch.written(found, "found"), gold, selected)  # read twice


def run_sql(selected: int, name: str = "run") -> str:
    """CTE of judged rows, after the CTEs of ``ranked`` and ``gold``."""
    return f"""{name} AS (
        SELECT g.query_id, count(*) AS n_gold, count(r.id) FILTER (r.rank <= {selected}) AS hits, count(r.id) AS candidate_hits,
               (SELECT count(*) FROM ranked x WHERE x.query_id = g.query_id AND x.rank <= {selected}) AS n_selected,
               coalesce(1 / min(r.rank) FILTER (r.rank <= {selected}), 0.0) AS reciprocal_rank, coalesce(sum(1 / log2(r.rank + 1)) FILTER (r.rank <= {selected}), 0.0) AS gain
        FROM gold g LEFT JOIN ranked r USING (query_id, id) GROUP BY g.query_id),
    {name}_n AS (SELECT *, CASE WHEN least(n_gold, n_selected) > 0 THEN gain / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, least(n_gold, n_selected) + 1)) AS i)) ELSE 0.0 END AS ndcg FROM {name})"""


BASE = f"{CORPUS}, {ASKED}, {bm25_sql('corpus', 'queries', {'text': 1.0, 'meta': 0.0}, 10)}, {HELD}"


@query(f"WITH {BASE}, {run_sql(5)} SELECT query_id, n_gold::INTEGER AS n_gold, hits::INTEGER AS hits, candidate_hits::INTEGER AS candidate_hits, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM run_n")
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 5).select("query_id", "n_gold", "hits", "candidate_hits", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"))


METRICS = ["any_gold", "all_gold", "macro_recall", "micro_recall", "candidate_any_gold", "mrr", "ndcg", "empty_rate", "mean_budget"]
METRICS_SQL = """count(*) AS scorable, round(avg((hits > 0)::INT), 6) AS any_gold, round(avg((hits = n_gold)::INT), 6) AS all_gold, round(avg(hits / n_gold), 6) AS macro_recall,
    round(sum(hits) / sum(n_gold), 6) AS micro_recall, round(avg((candidate_hits > 0)::INT), 6) AS candidate_any_gold, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
    round(avg((n_selected = 0)::INT), 6) AS empty_rate, round(avg(n_selected), 6) AS mean_budget"""


def _rounded(m: DataFrame, *keys: str) -> DataFrame:
    return m.select(*keys, "scorable", *(F.round(c, 6).alias(c) for c in METRICS))


@query(f"WITH {BASE}, {run_sql(5)} SELECT {METRICS_SQL} FROM run_n")
def metrics_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.metrics(_run(spark, sf_dir, 5)))


@query(f"""WITH {BASE}, {run_sql(5)}, c AS (SELECT *, 'all' AS cohort FROM run_n UNION ALL SELECT *, 'single' FROM run_n WHERE n_gold = 1 UNION ALL SELECT *, 'development' FROM run_n WHERE query_id % 3 = 0
    UNION ALL SELECT *, 'held_out' FROM run_n WHERE query_id % 3 <> 0) SELECT cohort, {METRICS_SQL} FROM c GROUP BY cohort""")
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = {"all": F.lit(True), "single": F.col("n_gold") == 1, "development": F.col("query_id") % 3 == 0, "held_out": F.col("query_id") % 3 != 0}
    return _rounded(evaluate.metrics(evaluate.cohorts(_run(spark, sf_dir, 5), tags), "cohort"), "cohort")


@query(f"""WITH {BASE}, {run_sql(1)} SELECT CASE WHEN hits > 0 THEN 'success' WHEN candidate_hits > 0 THEN 'found_not_packed' ELSE 'candidate_miss' END AS outcome, count(*) AS n FROM run_n GROUP BY ALL""")
def failure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.census(_run(spark, sf_dir, 1).withColumn("smallest_gold_block", F.lit(0)).withColumn("budget", F.lit(1)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs judge one search: its rows and the gold are written once and read by both."""
    found, gold = (scratch.written(x, n) for x, n in zip(_found(spark, sf_dir), ("found", "gold"), strict=True))
    return evaluate.paired(_judged(found, gold, 1), _judged(found, gold, 5), ["query_id"], "hits")


@query(f"""WITH {BASE}, {run_sql(1, 'one')}, {run_sql(5, 'five')} SELECT CASE WHEN f.hits > o.hits THEN 'win' WHEN f.hits < o.hits THEN 'loss' ELSE 'tie' END AS outcome, count(*) AS n
    FROM one_n o JOIN five_n f USING (query_id) GROUP BY ALL""")
def paired_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap(_pairs(spark, sf_dir).withColumn("cluster", F.col("query_id") % 50), "cluster")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
    SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
           max(value) FILTER (k = greatest(ceil(0.95 * n), 1)) AS p95_nearest, max(value) FILTER (k = floor(0.95 * (n - 1)) + 1) AS p95_floor FROM r GROUP BY ALL""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.percentiles(D.table(spark, sf_dir, "events"), "value", "event_type")
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")), "p95_nearest", "p95_floor")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    full = t.groupBy(F.col("session").alias("scope")).agg(F.sum(F.octet_length("text")).alias("full_tokens"))
    rows = t.select(F.col("session").alias("scope"), F.octet_length("text").alias("used"), (F.col("ord") % 2).cast("int").alias("hits"), F.explode(F.array(F.lit(300), F.lit(600))).alias("budget"))
    rows = rows.select("scope", F.lit("literal").alias("mode"), "budget", F.least("used", "budget").alias("budget_used"), F.when(F.col("budget") == 600, 1).otherwise(F.col("hits")).alias("hits"))
    return economics.cohort_costs(rows, full, 2.0, 0.2)


COSTS = """f AS (SELECT conv_id, sum(strlen(text)) AS ft FROM conversations GROUP BY ALL),
    r AS (SELECT conv_id, b AS budget, least(strlen(text), b) AS used, CASE WHEN b = 600 THEN 1 ELSE turn % 2 END AS hits FROM conversations, (SELECT unnest([300, 600]) AS b)),
    c AS (SELECT 'literal' AS mode, budget::INTEGER AS budget, rho, count(*) AS queries, sum(used)::BIGINT AS tokens, avg(used) AS mean_tokens, sum(used / 1e6 * (rho * 0.2 + (1 - rho) * 2)) AS cost,
                 sum(ft / 1e6 * (rho * 0.2 + (1 - rho) * 2)) AS full_cost, count(*) FILTER (hits > 0) AS with_gold FROM r JOIN f USING (conv_id), (SELECT unnest([0.0, 0.5, 0.9])::DOUBLE AS rho) GROUP BY ALL)"""


@query(f"""WITH {COSTS} SELECT mode, budget, rho, queries, tokens, round(mean_tokens, 6) AS mean_tokens, round(cost, 9) AS cost, round(full_cost, 9) AS full_cost, with_gold,
    round(cost / with_gold, 9) AS cost_per_gold, round(full_cost / cost, 6) AS full_ratio FROM c""")
def economics_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _costs(spark, sf_dir)
    return c.select("mode", "budget", "rho", "queries", "tokens", F.round("mean_tokens", 6).alias("mean_tokens"), *(F.round(x, 9).alias(x) for x in ("cost", "full_cost")), "with_gold", F.round("cost_per_gold", 9).alias("cost_per_gold"), F.round("full_ratio", 6).alias("full_ratio"))


@query(f"""WITH {COSTS}, d AS (SELECT mode, budget, cost - lag(cost) OVER w AS d_cost, with_gold / queries - lag(with_gold / queries) OVER w AS d_share, lag(budget) OVER w AS from_budget FROM c WHERE rho = 0 WINDOW w AS (PARTITION BY mode ORDER BY budget))
    SELECT mode, from_budget, budget AS to_budget, round(d_cost, 9) AS d_cost, round(d_share, 9) AS d_share, round(d_cost / (100 * d_share), 9) AS cost_per_point FROM d WHERE from_budget IS NOT NULL""")
def marginal_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = economics.marginal(_costs(spark, sf_dir).filter("rho = 0"))
    return m.select("mode", "from_budget", "to_budget", *(F.round(c, 9).alias(c) for c in ("d_cost", "d_share", "cost_per_point")))


@query(f"""WITH {EVENTS}, {TOTALS}, {BASE}, {run_sql(5)} SELECT (SELECT count(*) FROM run_n) AS queries, (SELECT sum(hits) FROM run_n)::BIGINT AS gold_found, (SELECT sum(n_gold) FROM run_n)::BIGINT AS gold_total,
    round((SELECT sum(hits) / sum(n_gold) FROM run_n), 6) AS recall, events, demand_count, miss_count, miss_extra_tokens FROM totals""")
def evidence_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = economics.evidence(telemetry.totals(D.telemetry(spark, sf_dir)), _run(spark, sf_dir, 5))
    return e.select("queries", "gold_found", "gold_total", F.round("recall", 6).alias("recall"), "events", "demand_count", "miss_count", "miss_extra_tokens")


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        o_totalprice + CASE WHEN o_orderkey % 7 = 2 THEN 0.5 ELSE 0.001 END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 4),
    j AS (SELECT l.*, r.o_orderstatus AS s2, r.o_totalprice AS p2 FROM l LEFT JOIN r USING (o_orderkey))
    SELECT 'o_orderstatus' AS field, count(*) FILTER (s2 IS NOT NULL AND s2 <> o_orderstatus) AS mismatches, 0::BIGINT AS missing_left, count(*) FILTER (s2 IS NULL) AS missing_right FROM j
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (s2 IS NOT NULL AND abs(p2 - o_totalprice) > 0.01), 0, count(*) FILTER (s2 IS NULL) FROM j""")
def parity_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    other = o.filter(k % 11 != 4).withColumn("o_orderstatus", F.when(k % 10 == 3, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 7 == 2, 0.5).otherwise(0.001))
    return evaluate.parity(o, other, ["o_orderkey"], ["o_orderstatus"], {"o_totalprice": 0.01})


@query("""SELECT s_suppkey, s_nationkey, s_acctbal, (s_suppkey % 37)::BIGINT AS lag_ms FROM supplier a WHERE NOT EXISTS (
    SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey AND b.s_acctbal <= a.s_acctbal AND b.s_suppkey % 37 <= a.s_suppkey % 37
        AND (b.s_acctbal < a.s_acctbal OR b.s_suppkey % 37 < a.s_suppkey % 37))""")
def pareto_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 37).alias("lag_ms"))
    return planners.skyline(s, "s_suppkey", ["s_acctbal", "lag_ms"], ["s_nationkey"])


@query("""WITH s AS (SELECT (user_id % 4)::BIGINT AS workload, CASE WHEN event_id % 3 = 0 THEN 'base' WHEN event_id % 3 = 1 THEN 'fast' ELSE 'same' END AS candidate,
        100 + (event_id % 5) * 0.1 - CASE WHEN event_id % 3 = 1 THEN 40 ELSE 0 END AS ms FROM events),
    m AS (SELECT workload, candidate, median(ms) AS med, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT workload, candidate, median(abs(ms - med)) AS mad FROM s JOIN m USING (workload, candidate) GROUP BY ALL),
    x AS (SELECT * FROM m JOIN d USING (workload, candidate)), j AS (SELECT c.workload, c.candidate, b.med AS bm, c.med AS cm, 3 * 1.4826 * (b.mad + c.mad) AS noise, least(b.n, c.n) AS n FROM x c JOIN x b ON b.workload = c.workload AND b.candidate = 'base' WHERE c.candidate <> 'base')
    SELECT workload, candidate, round(bm, 6) AS base_median, round(cm, 6) AS median, round(noise, 6) AS noise, round(bm - cm - noise, 6) AS conservative,
           round(greatest(noise, 0.25, bm * 0.05), 6) AS threshold, bm - cm - noise > greatest(noise, 0.25, bm * 0.05) AND n >= 5 AS accepted FROM j""")
def gain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = D.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("workload"), F.when(k % 3 == 0, "base").when(k % 3 == 1, "fast").otherwise("same").alias("candidate"), (100 + (k % 5) * 0.1 - F.when(k % 3 == 1, 40).otherwise(0)).alias("ms")
    )
    g = planners.gain_gate(s, "base")
    return g.select("workload", "candidate", *(F.round(c, 6).alias(c) for c in ("base_median", "median", "noise", "conservative", "threshold")), "accepted")


@query("""WITH t AS (SELECT n_name AS target, (n_nationkey * 40)::BIGINT AS cap, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE (n_nationkey % 7 + 1)::DOUBLE END AS p, (n_nationkey * 10)::DOUBLE AS mb, n_nationkey % 2 = 0 AS dur FROM nation),
    n AS (SELECT r_name AS need, (r_regionkey * 100)::BIGINT AS bytes, 3.0 AS mp, 150.0 AS mm, r_regionkey % 2 = 1 AS dn FROM region),
    j AS (SELECT need, target, p, array_to_string(list_filter([CASE WHEN bytes > cap THEN 'capacity' END, CASE WHEN dn AND NOT dur THEN 'durability' END,
        CASE WHEN NOT (coalesce(p <= mp, false) OR mb >= mm) THEN 'too_slow' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n, t)
    SELECT need, target, reasons, reasons = '' AND row_number() OVER (PARTITION BY need ORDER BY (reasons <> '')::INT, p NULLS LAST, target) = 1 AS chosen FROM j""")
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    targets = D.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("target"), (k * 40).alias("capacity"), F.when(k % 5 != 4, (k % 7 + 1).cast("double")).alias("p95_ms"), (k * 10).cast("double").alias("mb_per_s"), (k % 2 == 0).alias("durable")
    )
    needs = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("need"), (r * 100).alias("bytes"), F.lit(3.0).alias("max_p95_ms"), F.lit(150.0).alias("min_mb_per_s"), (r % 2 == 1).alias("durable_needed"))
    return planners.placement(targets, needs)


@query("""WITH r AS (SELECT o_orderkey AS task_id, count(*) FILTER (l_returnflag = 'R') AS num, count(*) AS den FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT round(avg(num / den), 9) AS macro, round(sum(num) / sum(den), 9) AS micro, (SELECT count(*) FROM orders) - count(*) AS missing, 0::BIGINT AS unknown FROM r""")
def outcome_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    lines = D.table(spark, sf_dir, "lineitem").join(tasks, F.col("l_orderkey") == F.col("task_id"), "left_semi")
    results = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count("*").alias("den"))
    o = evaluate.outcomes(tasks, results)
    return o.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "missing", "unknown")


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", (F.row_number().over(w) - 1).alias("position"))


QUERIES["running_position"] = window_rank
SQL["running_position"] = "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS position FROM events"


MODES = {"first": lambda n: F.col("rank") <= n, "last": lambda n: F.col("rank") > 10 - n}
CUBE_AVERAGES = ["any_gold_hit_rate", "all_gold_hit_rate", "macro_evidence_recall", "micro_evidence_recall", "parent_locator_coverage", "empty_context_rate", "mean_budget_used", "latency_p50", "latency_p95", "latency_p99"]


@query(f"""WITH {BASE}, config AS (SELECT * FROM (VALUES ('first', 5), ('first', 10), ('last', 5), ('last', 10)) c(mode, budget)),
    picked AS (SELECT mode, budget, query_id, id FROM config JOIN ranked ON CASE mode WHEN 'first' THEN rank <= budget ELSE rank > 10 - budget END),
    sizes AS (SELECT mode, budget, query_id, count(*) AS n FROM picked GROUP BY ALL), golds AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL),
    hit AS (SELECT mode, budget, query_id, count(*) AS n FROM picked JOIN gold USING (query_id, id) GROUP BY ALL), near AS (SELECT query_id, count(*) AS n FROM ranked JOIN gold USING (query_id, id) GROUP BY ALL),
    legacy AS (SELECT config.mode, config.budget, item_id % 5 + 1 AS category, coalesce(g.n, 0) AS gold, item_id % 7 <> 0 AS resolved, item_id % 5 = 4 AS diagnostic, coalesce(h.n, 0) AS hits, coalesce(c.n, 0) AS parents, coalesce(s.n, 0) AS packed, length(text) AS ms
               FROM benchmark CROSS JOIN config LEFT JOIN golds g ON g.query_id = item_id LEFT JOIN hit h ON h.query_id = item_id AND h.mode = config.mode AND h.budget = config.budget
               LEFT JOIN near c ON c.query_id = item_id LEFT JOIN sizes s ON s.query_id = item_id AND s.mode = config.mode AND s.budget = config.budget),
    r AS (SELECT *, gold > 0 AND resolved AND NOT diagnostic AS ok FROM legacy)
    SELECT mode, budget, category, grouping_id(mode, budget, category)::INTEGER AS level, count(*) AS tasks, count(*) FILTER (ok) AS scorable, count(*) FILTER (gold = 0) AS no_gold, count(*) FILTER (NOT resolved) AS unresolved,
           count(*) FILTER (diagnostic) AS diagnostic_only, coalesce(sum(hits) FILTER (ok), 0)::BIGINT AS hits, coalesce(sum(gold) FILTER (ok), 0)::BIGINT AS gold, round(avg((hits > 0)::INT) FILTER (ok), 6) AS any_gold_hit_rate,
           round(avg((hits = gold)::INT) FILTER (ok), 6) AS all_gold_hit_rate, round(avg(hits / gold) FILTER (ok), 6) AS macro_evidence_recall, round(sum(hits) FILTER (ok) / sum(gold) FILTER (ok), 6) AS micro_evidence_recall,
           round(avg((parents > 0)::INT) FILTER (ok), 6) AS parent_locator_coverage, round(avg((packed = 0)::INT), 6) AS empty_context_rate, round(avg(packed), 6) AS mean_budget_used,
           round(quantile_cont(ms, 0.5), 6) AS latency_p50, round(quantile_cont(ms, 0.95), 6) AS latency_p95, round(quantile_cont(ms, 0.99), 6) AS latency_p99
    FROM r GROUP BY GROUPING SETS ((mode, budget, category), (mode, budget), (mode), ())""")
def metrics_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy rows of four configurations for every question, at all levels of the cube, checked; a question's length stands for its time."""
    asked = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.char_length("text").alias("total_ms"))
    found = lexical.bm25(_corpus(spark, sf_dir), _asked(spark, sf_dir, "corpus"), [("text", 1.0), ("meta", 0.0)], "tokens", 10)
    gold = R.gold(D.articles(spark, sf_dir), D.questions(spark, sf_dir)).withColumn("is_gold", F.lit(True))
    marked = found.select("query_id", "id", "rank").join(gold, ["query_id", "id"], "left")
    configs = [(m, b) for m in MODES for b in BUDGETS]
    counts = [x for m, b in configs for x in (F.count_if(MODES[m](b)).alias(f"n_{m}_{b}"), F.count_if(MODES[m](b) & F.col("is_gold")).alias(f"h_{m}_{b}"))]
    per_query = marked.groupBy("query_id").agg(F.count_if("is_gold").alias("parents"), *counts)
    wide = asked.join(per_query, "query_id", "left").join(gold.groupBy("query_id").agg(F.count("*").alias("golds")), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(b).alias("budget"), zero(f"h_{m}_{b}").alias("hits"), zero(f"n_{m}_{b}").alias("selected_count")) for m, b in configs))
    legacy = wide.withColumn("c", F.explode(rows)).select(
        "c.*", (F.col("query_id") % 5 + 1).alias("category"), zero("golds").alias("evidence_count"), (F.col("query_id") % 7 != 0).alias("fully_resolved"), zero("parents").alias("parent_locator_hits"), F.col("c.selected_count").alias("budget_used"), "total_ms"
    )
    cells = cubes.checked(cubes.cube(cubes.projected(legacy, "locomo")), list(MODES), list(BUDGETS))
    return cells.select(*(c if c not in CUBE_AVERAGES else F.round(c, 6).alias(c) for c in cells.columns))


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT CASE WHEN conv_id % 8 = 0 OR (n < 3 AND conv_id % 8 <> 7) THEN 'identical' WHEN conv_id % 8 = 1 THEN 'numeric-only' WHEN conv_id % 8 = 2 THEN 'diagnostic-only' WHEN conv_id % 8 = 3 THEN 'rank-only'
                WHEN conv_id % 8 = 4 THEN 'same-set-different-order' WHEN conv_id % 8 = 5 THEN 'packed-boundary-change' WHEN conv_id % 8 = 6 THEN 'selected-set-change' ELSE 'other-semantic-change' END AS drift, count(*) AS n
    FROM s GROUP BY ALL""")
def drift_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all conversations, of which the second differs in one way for each remainder of the number by eight."""
    turns = D.turns(spark, sf_dir).groupBy(F.col("session").cast("long").alias("conv")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    first = F.slice("ids", 1, 2)
    run = turns.select("conv", first.alias("selected_ids"), first.alias("selected_ranked_ids"), first.alias("packed"), F.lit(9).alias("budget_used"), F.lit(0.5).alias("score"), F.lit("a").alias("diagnostics"), (F.size("ids") >= 3).alias("enough"), "ids")
    way = lambda n, new, old: F.when(F.col("enough") & (F.col("conv") % 8 == n), new).otherwise(F.col(old))
    other = run.select(
        "conv", F.when(F.col("enough") & (F.col("conv") % 8 == 6), F.slice("ids", 2, 2)).otherwise(way(4, F.reverse("selected_ids"), "selected_ids")).alias("selected_ids"),
        F.when(F.col("enough") & (F.col("conv") % 8 == 6), F.slice("ids", 2, 2)).otherwise(F.when(F.col("enough") & (F.col("conv") % 8).isin(3, 4), F.reverse("selected_ranked_ids")).otherwise(F.col("selected_ranked_ids"))).alias("selected_ranked_ids"),
        way(4, F.reverse("packed"), "packed").alias("packed"), way(5, F.lit(10), "budget_used").alias("budget_used"), way(1, F.lit(0.6), "score").alias("score"), way(2, F.lit("b"), "diagnostics").alias("diagnostics"),
    )
    return evaluate.drift(run, other.filter("conv % 8 <> 7"), ["conv"])
