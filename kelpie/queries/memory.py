"""Queries over telemetry, activity and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, mentions, observe, policy, residency, sketches, telemetry
from ..sources import driver as D
from ..sources import readers, scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EVENTS = """ev AS (
    SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS task_id,
           CASE event_type WHEN 'view' THEN 'planned_retrieval' WHEN 'click' THEN 'resident_hit' WHEN 'purchase' THEN 'resident_miss' WHEN 'error' THEN 'hard_miss' ELSE 'prefetch' END AS kind,
           'item' || (props->>'$.k') AS item_id, round(value)::BIGINT AS extra_tokens, value, event_id % 2 = 0 AS avoidable, event_id % 3 = 0 AS used,
           CASE WHEN event_id % 5 <> 0 THEN event_id % 7 = 0 END AS avoided_miss,
           CASE WHEN event_id % 7 = 0 THEN round(value)::BIGINT * 2 ELSE 0 END AS avoided_tokens, ts FROM events)"""
_D = "kind IN ('resident_hit', 'resident_miss', 'hard_miss')"
_M = "kind IN ('resident_miss', 'hard_miss')"
_P = "kind = 'prefetch'"
TOTALS = f"""totals AS (
    SELECT count(*) AS events, count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER ({_D}) AS demand_tasks,
           count(*) FILTER ({_D}) AS demand_count, count(*) FILTER ({_M}) AS miss_count, count(*) FILTER (kind = 'hard_miss') AS n_hard_miss,
           count(*) FILTER ({_M} AND avoidable) AS avoidable_miss_count, sum(extra_tokens) FILTER ({_M})::BIGINT AS miss_extra_tokens,
           count(*) FILTER ({_P}) AS n_prefetch, count(*) FILTER ({_P} AND used) AS prefetch_used, count(*) FILTER ({_P} AND avoided_miss) AS avoided_misses,
           sum(extra_tokens) FILTER ({_P})::BIGINT AS injected_tokens, sum(extra_tokens) FILTER ({_P} AND NOT used)::BIGINT AS unused_injected_tokens,
           sum(avoided_tokens) FILTER ({_P})::BIGINT AS avoided_extra_tokens FROM ev)"""
ITEMS = f"""items AS (
    SELECT item_id, count(*) FILTER ({_D}) AS needs, count(*) FILTER ({_M}) AS misses, count(*) FILTER ({_M} AND avoidable) AS avoidable_misses,
           coalesce(sum(extra_tokens) FILTER ({_M} AND avoidable), 0)::BIGINT AS avoidable_extra_tokens, count(*) FILTER ({_P}) AS n_prefetch, count(*) FILTER ({_P} AND used) AS prefetch_used,
           coalesce(sum(avoided_tokens) FILTER ({_P}), 0)::BIGINT AS prefetch_avoided_tokens, coalesce(sum(extra_tokens) FILTER ({_P}), 0)::BIGINT AS prefetch_tokens,
           count(DISTINCT task_id) FILTER ({_D}) AS demand_tasks FROM ev WHERE item_id IS NOT NULL GROUP BY item_id)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.checked(D.telemetry(spark, sf_dir))


@query(f"""WITH {EVENTS}, {TOTALS} SELECT events, tasks, demand_tasks, demand_count, miss_count, avoidable_miss_count, miss_extra_tokens, prefetch_used, avoided_misses, injected_tokens,
    unused_injected_tokens, avoided_extra_tokens, round(miss_count / demand_count, 9) AS resident_miss_rate, round(n_hard_miss / demand_count, 9) AS hard_miss_rate,
    round(avoidable_miss_count / demand_count, 9) AS avoidable_miss_rate, round(prefetch_used / n_prefetch, 9) AS prefetch_accuracy,
    round(avoided_misses / (avoidable_miss_count + avoided_misses), 9) AS prefetch_coverage, avoided_extra_tokens - injected_tokens AS prefetch_net_tokens FROM totals""")
def telemetry_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ["resident_miss_rate", "hard_miss_rate", "avoidable_miss_rate", "prefetch_accuracy", "prefetch_coverage"]
    counts = "events tasks demand_tasks demand_count miss_count avoidable_miss_count miss_extra_tokens prefetch_used avoided_misses injected_tokens unused_injected_tokens avoided_extra_tokens".split()
    return telemetry.totals(_events(spark, sf_dir)).select(*counts, *(F.round(r, 9).alias(r) for r in rates), "prefetch_net_tokens")


@query(f"""WITH {EVENTS}, {ITEMS} SELECT item_id, needs, misses, avoidable_misses, avoidable_extra_tokens, prefetch_used, demand_tasks, round(misses / nullif(needs, 0), 9) AS miss_rate,
    round(avoidable_misses / nullif(needs, 0), 9) AS avoidable_miss_rate, round(demand_tasks / (SELECT count(DISTINCT task_id) FROM ev WHERE {_D}), 9) AS need_task_rate,
    round(avoidable_extra_tokens / nullif(avoidable_misses, 0), 9) AS avg_avoidable_extra_tokens, prefetch_avoided_tokens - prefetch_tokens AS prefetch_net_tokens FROM items""")
def telemetry_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ["miss_rate", "avoidable_miss_rate", "need_task_rate", "avg_avoidable_extra_tokens"]
    i = telemetry.items(_events(spark, sf_dir)).withColumn("demand_tasks", F.size("demand_task_ids").cast("long"))
    return i.select("item_id", "needs", "misses", "avoidable_misses", "avoidable_extra_tokens", "prefetch_used", "demand_tasks", *(F.round(r, 9).alias(r) for r in rates), "prefetch_net_tokens")


@query(f"""WITH {EVENTS}, {ITEMS}, m AS (SELECT median(needs)::INTEGER AS least FROM items)
    SELECT item_id, needs < least AS suppressed, CASE WHEN needs < least THEN 0 ELSE needs END AS needs, CASE WHEN needs < least THEN 0 ELSE avoidable_extra_tokens END AS avoidable_extra_tokens,
           (CASE WHEN needs < least THEN 0 ELSE demand_tasks END)::INTEGER AS n_tasks FROM items, m""")
def low_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = telemetry.items(_events(spark, sf_dir))
    least = items.agg(F.expr("cast(round(median(needs)) AS int)").alias("m")).first().m  # one number
    return telemetry.low_support(items, least).select("item_id", "suppressed", "needs", "avoidable_extra_tokens", F.size("demand_task_ids").alias("n_tasks"))


@query(f"""WITH {EVENTS}, {TOTALS}, s AS (SELECT demand_count, (n_prefetch - prefetch_used) / n_prefetch AS pollution, greatest(0, avoidable_miss_count / demand_count - 0.1) AS g FROM totals),
    t AS (SELECT *, greatest(0, 0.85 - 0.8) + 0.5 * pollution AS h FROM s)
    SELECT demand_count, round(pollution, 9) AS pollution, round(g, 9) AS grow_signal, round(h, 9) AS shrink_signal,
           CASE WHEN demand_count < 20 THEN 'hold' WHEN g - h > 0.05 THEN 'grow' WHEN g - h < -0.05 THEN 'shrink' ELSE 'hold' END AS action,
           (CASE WHEN demand_count < 20 THEN 200 WHEN g - h > 0.05 THEN 250 WHEN g - h < -0.05 THEN 150 ELSE 200 END)::BIGINT AS suggested_budget FROM t""")
def budget_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry.budget_step(telemetry.totals(_events(spark, sf_dir)), 200, 0.85, least=100, most=500, step=50)
    return t.select("demand_count", *(F.round(c, 9).alias(c) for c in ("pollution", "grow_signal", "shrink_signal")), "action", "suggested_budget")


@query(f"""WITH {EVENTS}, {ITEMS}, task AS (SELECT DISTINCT item_id, task_id FROM ev WHERE {_D}),
    seed AS (SELECT item_id FROM items ORDER BY needs DESC, item_id LIMIT 5), st AS (SELECT * FROM task WHERE item_id IN (FROM seed)), ot AS (SELECT * FROM task WHERE item_id NOT IN (FROM seed)),
    size AS (SELECT item_id, count(*) AS n FROM st GROUP BY ALL),
    sup AS (SELECT s.item_id AS seed_id, o.item_id, count(*) AS support FROM st s JOIN ot o USING (task_id) GROUP BY ALL),
    best AS (SELECT sup.item_id, seed_id, support / n AS confidence, support FROM sup JOIN size ON seed_id = size.item_id WHERE support >= 2 AND support / n >= 0.01
             QUALIFY row_number() OVER (PARTITION BY sup.item_id ORDER BY support / n DESC, support DESC, seed_id) = 1)
    SELECT item_id, seed_id, round(confidence, 9) AS confidence, support, round(coalesce(avoidable_extra_tokens / nullif(avoidable_misses, 0), -1), 9) AS penalty
    FROM best JOIN items USING (item_id) ORDER BY best.confidence DESC, support DESC, penalty DESC, item_id LIMIT 20""")
def prefetch_codemand(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = telemetry.items(_events(spark, sf_dir))
    seeds = items.orderBy(F.desc("needs"), "item_id").limit(5)  # a top-k report
    p = telemetry.prefetch_plan(items, seeds, 2, 0.01, 20)
    return p.select("item_id", "seed_id", F.round("confidence", 9).alias("confidence"), "support", F.round("penalty", 9).alias("penalty"))


NOW = "2024-03-01"


@query("""WITH a AS (SELECT unnest(range(0, 400)) AS age)
    SELECT age::BIGINT AS age, round((age + 1) ** -0.5, 9) AS legacy, round(2 ** (-age / 30.0), 9) AS exponential, round(0.7 * 2 ** (-age / 30.0) + 0.3 * 2 ** (-age / 120.0), 9) AS mixture,
           round((1 + age / 10.0) ** -0.5, 9) AS power, CASE WHEN age > 180 THEN 0.0 ELSE round((1 + age / 10.0) ** -0.5, 9) END AS bounded_power FROM a""")
def decay_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(400).select(F.col("id").alias("age"), *(F.round(S.decay(F.col("id"), k), 9).alias(k) for k in S.KERNELS))


USES = f"""uses AS (SELECT 'item' || (props->>'$.k') AS entry_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 2.0 WHEN event_type = 'signup' THEN 1.5 WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END AS w,
    date_diff('day', ts::DATE, DATE '{NOW}') AS age, ts::DATE AS day FROM events), daily AS (SELECT entry_id, age, sum(w) AS weight FROM uses WHERE w > 0 GROUP BY ALL)"""
ACT = "act AS (SELECT entry_id, sum(least(weight, 2.0) * CASE WHEN age > 180 THEN 0 ELSE (1 + age / 10.0) ** -0.5 END) AS activity FROM daily GROUP BY ALL)"


def _activity(spark: SparkSession, sf_dir: str, kernel: str = "bounded_power") -> DataFrame:
    now = F.lit(NOW).cast("date")
    return policy.activity(policy.checked_uses(D.use_events(spark, sf_dir), now), now, kernel)


@query(f"WITH {USES}, {ACT} SELECT entry_id, round(activity, 6) AS activity FROM act")
def activity_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir).withColumn("activity", F.round("activity", 6))


@query(f"WITH {USES} SELECT entry_id, round(1 / (1 + min(age)), 9) AS lru, round(sum(weight), 6) AS lfu FROM daily GROUP BY ALL")
def activity_lru_lfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    lru, lfu = _activity(spark, sf_dir, "lru"), _activity(spark, sf_dir, "lfu")
    return lru.select("entry_id", F.round("activity", 9).alias("lru")).join(lfu.select("entry_id", F.round("activity", 6).alias("lfu")), "entry_id")


ENTRIES = """entries AS (SELECT 'item' || k AS id, CASE WHEN k % 4 = 0 THEN 'T0' ELSE 'T1' END AS tier,
    CASE WHEN k % 29 = 9 THEN '../outside.md' WHEN k % 31 = 7 THEN '/etc/absolute.md' ELSE 'warm/' || (k % 10) || '/topic_' || (k % 25) || '.md' END AS locator, 'scope' || (k % 2) AS scope,
    ['low', 'med', 'high'][k % 3 + 1] AS cost_class, k % 23 = 0 AS pinned, CASE WHEN k % 17 = 5 THEN 'invalid' ELSE 'active' END AS status, 5 + k % 13 AS resident_units,
    CASE WHEN k % 3 = 0 THEN (k % 50)::DOUBLE END AS miss_penalty_tokens, DATE '2023-10-01' + (k % 60)::INTEGER AS created,
    CASE WHEN k % 11 = 3 THEN DATE '2024-06-01' WHEN k % 11 = 4 THEN DATE '2023-12-24' END AS valid_from, CASE WHEN k % 13 = 4 THEN DATE '2024-01-15' END AS valid_until,
    CASE WHEN k % 7 = 2 THEN DATE '2024-02-01' WHEN k % 7 = 3 THEN DATE '2024-12-01' END AS next_review, CASE WHEN k % 2 = 0 THEN 'MEMORY.md' ELSE 'USER.md' END AS store,
    sha256(CASE WHEN k % 2 = 0 THEN 'MEMORY.md' ELSE 'USER.md' END || chr(0) || 'text ' || k) AS source_hash
    FROM (SELECT DISTINCT (props->>'$.k')::BIGINT AS k FROM events))"""
CURRENT = f"(status = 'active' AND coalesce(valid_from <= DATE '{NOW}', true) AND coalesce(DATE '{NOW}' < valid_until, true))"


@query(f"""WITH {EVENTS}, {ITEMS}, {ENTRIES}, task AS (SELECT DISTINCT item_id, task_id FROM ev WHERE {_D}),
    asked AS (SELECT item_id FROM items ORDER BY needs DESC, item_id LIMIT 20),
    st AS (SELECT t.* FROM task t JOIN entries ON id = item_id WHERE {CURRENT} AND item_id IN (FROM asked) AND (SELECT demand_tasks FROM items i WHERE i.item_id = t.item_id) >= 2),
    ot AS (SELECT t.* FROM task t JOIN entries ON id = item_id WHERE {CURRENT} AND tier = 'T1' AND starts_with(locator, 'warm/') AND item_id NOT IN (FROM asked)),
    size AS (SELECT item_id, count(*) AS n FROM st GROUP BY ALL),
    sup AS (SELECT s.item_id AS seed_id, o.item_id, count(*) AS support FROM st s JOIN ot o USING (task_id) GROUP BY ALL),
    best AS (SELECT sup.item_id, seed_id, support / n AS confidence, support FROM sup JOIN size ON seed_id = size.item_id WHERE support >= 2 AND support / n >= 0.01
             QUALIFY row_number() OVER (PARTITION BY sup.item_id ORDER BY support / n DESC, support DESC, seed_id) = 1)
    SELECT best.item_id, seed_id, round(confidence, 9) AS confidence, support, round(coalesce(miss_penalty_tokens, avoidable_extra_tokens / nullif(avoidable_misses, 0), -1), 9) AS penalty
    FROM best JOIN items USING (item_id) JOIN entries ON id = best.item_id""")
def prefetch_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of prefetching: entries that are current, of the warm tier and safely locatable."""
    items = telemetry.items(_events(spark, sf_dir))
    seeds = items.orderBy(F.desc("needs"), "item_id").limit(20)  # what is active now: a bounded set
    p = telemetry.prefetch_plan(items, seeds, 2, 0.01, None, D.entries(spark, sf_dir), F.lit(NOW).cast("date"))
    return p.select("item_id", "seed_id", F.round("confidence", 9).alias("confidence"), "support", F.round("penalty", 9).alias("penalty"))


@query(f"""WITH {USES}, {ACT}, {ENTRIES}, hits AS (SELECT 'item' || (props->>'$.k') AS hit_id, max(ts::DATE) AS last_hit FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
    e AS (SELECT *, coalesce(activity, 0) AS a, date_diff('day', created, DATE '{NOW}') AS age, date_diff('day', coalesce(last_hit, created), DATE '{NOW}') AS idle,
                 CASE WHEN NOT {CURRENT} THEN 'status_or_validity' WHEN tier = 'T0' AND starts_with(source_hash, '0') THEN 'source_changed_or_removed' END AS reason
          FROM entries LEFT JOIN act ON id = entry_id LEFT JOIN hits ON id = hit_id),
    c AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN tier = 'T0' THEN CASE WHEN a >= 12 OR age <= 21 THEN 'keep' WHEN pinned THEN 'pinned_low_activity' ELSE 'demote' END
                         WHEN a < 10 AND idle > 2 AND NOT pinned THEN 'archive' ELSE 'keep' END AS class FROM e)
    SELECT id, tier, class, reason, reason IS NULL AND coalesce(next_review <= DATE '{NOW}', false) AS review_due, round(a, 6) AS activity, age::INTEGER AS age, idle::INTEGER AS idle,
           CASE WHEN tier = 'T0' AND reason IS NULL THEN row_number() OVER (PARTITION BY tier = 'T0' AND reason IS NULL ORDER BY a DESC, id) END::INTEGER AS rank,
           CASE WHEN class = 'demote' THEN row_number() OVER (PARTITION BY class = 'demote' ORDER BY list_position(['low', 'med', 'high'], cost_class), a, id) END::INTEGER AS demote_rank FROM c""")
def audit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, uses = D.entries(spark, sf_dir), D.use_events(spark, sf_dir)
    hits = uses.filter("type = 'hit'").groupBy(F.col("entry_id").alias("id")).agg(F.max("t").alias("last_hit"))
    a = policy.audit(e, _activity(spark, sf_dir), F.lit(NOW).cast("date"), hits, D.active_sources(e), demote_below=12.0, archive_below=10.0, archive_after=2)
    return a.withColumn("activity", F.round("activity", 6))


@query(f"""WITH {USES}, {ACT}, {ENTRIES}, e AS (SELECT id, pinned, resident_units AS u, activity * CASE cost_class WHEN 'low' THEN 1 WHEN 'med' THEN 1.25 ELSE 1.5 END AS s FROM entries JOIN act ON id = entry_id WHERE status = 'active'),
    r AS (SELECT list_reduce(list({{'u': u::BIGINT, 'ids': [id], 'p': pinned, 's': s}} ORDER BY NOT pinned, CASE WHEN pinned THEN 0 ELSE -round(s / u, 12) END, id), lambda a, x:
        CASE WHEN x.p OR (x.s > 0 AND a.u + x.u <= 300) THEN {{'u': a.u + x.u, 'ids': a.ids || x.ids, 'p': false, 's': 0.0::DOUBLE}} ELSE a END,
        {{'u': 0::BIGINT, 'ids': []::VARCHAR[], 'p': false, 's': 0.0::DOUBLE}}) AS r FROM e)
    SELECT 'OK' AS status, list_aggregate(r.ids, 'string_agg', ',') AS selected, r.u AS budget_used FROM r""")
def greedy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.entries(spark, sf_dir).filter("status = 'active'").join(_activity(spark, sf_dir), F.col("id") == F.col("entry_id"))
    return policy.greedy_plan(e, 300).select("status", F.array_join("selected", ",").alias("selected"), "budget_used")


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    events = _events(spark, sf_dir)
    n = events.agg(F.count_distinct("task_id").alias("n")).first().n  # one number
    current = D.entries(spark, sf_dir).filter("status = 'active'")
    return residency.values(current, telemetry.items(events), n), n


@query(f"""WITH {EVENTS}, {ITEMS}, {ENTRIES}, n AS (SELECT count(DISTINCT task_id) AS n FROM ev),
    v AS (SELECT id, tier, pinned, resident_units AS units, coalesce(demand_tasks, 0) / n * 20 AS need, coalesce(avoidable_misses / nullif(needs, 0), 0) AS rate, miss_penalty_tokens AS cat,
                 coalesce(miss_penalty_tokens, avoidable_extra_tokens / nullif(avoidable_misses, 0)) AS penalty FROM entries LEFT JOIN items ON id = item_id, n WHERE status = 'active'),
    w AS (SELECT *, CASE WHEN penalty IS NULL THEN NULL WHEN tier = 'T0' AND cat IS NOT NULL THEN need ELSE need * rate END AS expected FROM v)
    SELECT id, tier, round(penalty, 6) AS penalty, round(expected, 6) AS expected_misses, (units * 20)::BIGINT AS carry, round(expected * penalty - units * 20, 6) AS net,
           CASE WHEN tier = 'T0' AND (pinned OR penalty IS NULL) THEN 'fixed' WHEN expected * penalty - units * 20 > 0 THEN 'candidate' WHEN tier = 'T0' THEN 'fixed' ELSE 'out' END AS role FROM w""")
def residency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residency.guarded(_rows(spark, sf_dir)[0])
    return r.select("id", "tier", F.round("penalty", 6).alias("penalty"), F.round("expected_misses", 6).alias("expected_misses"), "carry", F.round("net", 6).alias("net"), "role")


@query()
def knapsack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _rows(spark, sf_dir)
    return residency.shadow_plan(rows, 400, n)


@query()
def replay_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = D.use_events(spark, sf_dir).filter("type = 'hit'").withColumn("grp", F.date_format("t", "yyyy-MM"))
    return policy.replay(uses, D.entries(spark, sf_dir).filter("status = 'active'"), 300)


DIRECTORY = f"""last AS (SELECT entry_id, max(day) AS last_use FROM uses GROUP BY ALL),
    current AS (SELECT *, greatest(created, valid_from, last_use) AS day FROM entries LEFT JOIN last ON id = entry_id
                WHERE tier = 'T1' AND {CURRENT} AND NOT starts_with(locator, '/') AND NOT starts_with(locator, '../')),
    g AS (SELECT scope, locator, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, max(day) AS latest, arg_max(substr(source_hash, 1, 12), row(day, id)) AS revision, bool_or(pinned) AS pinned,
                 max(list_position(['low', 'med', 'high'], cost_class))::INTEGER AS cost FROM current GROUP BY ALL),
    l AS (SELECT *, replace(regexp_extract(locator, '([^/]*)\\.md$', 1), '_', ' ') AS topic FROM g),
    lines AS (SELECT *, topic || ' | ' || scope || ' | ' || n || ' current | ' || strftime(latest, '%Y-%m-%d') || ' | rev:' || revision || ' | ' || locator AS line FROM l)"""


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = D.use_events(spark, sf_dir).groupBy(F.col("entry_id").alias("id")).agg(F.max("t").alias("last_use"))
    return policy.directory(D.entries(spark, sf_dir), last, F.lit(NOW).cast("date"))


@query(f"WITH {USES}, {ENTRIES}, {DIRECTORY} SELECT scope, locator, ids, n, latest, revision, pinned, cost, line FROM lines")
def warm_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir).select("scope", "locator", F.array_join("ids", ",").alias("ids"), "n", "latest", "revision", "pinned", "cost", "line")


@query(f"""WITH {USES}, {ENTRIES}, {DIRECTORY}, r AS (SELECT list_reduce(list({{'u': strlen(line)::BIGINT + 1, 'k': [scope || ' ' || locator]}} ORDER BY pinned DESC, cost DESC, n DESC, topic, locator),
        lambda a, x: CASE WHEN a.u + x.u <= 900 THEN {{'u': a.u + x.u, 'k': a.k || x.k}} ELSE a END, {{'u': 0::BIGINT, 'k': []::VARCHAR[]}}) AS r FROM lines)
    SELECT scope, locator, strlen(line)::INTEGER + 1 AS units, list_contains((SELECT r.k FROM r), scope || ' ' || locator) AS kept FROM lines""")
def directory_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.pack_directory(_directory(spark, sf_dir), 900).select("scope", "locator", "units", "kept")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    seconds = F.lit(1704067200) + F.col("session").cast("long") * 86400 + F.col("ord") * 60
    return t.select("id", "session", F.col("speaker").alias("role"), "text", F.timestamp_seconds(seconds).alias("ts"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in a window from the table's first stamp to its last."""
    records = _records(spark, sf_dir)
    ends = records.agg(F.max("ts").alias("now"), (F.date_diff(F.max("ts"), F.min("ts")) + 1).alias("days")).first()  # two numbers
    records = observe.windowed(records, F.lit(ends.now), ends.days or 0)
    words = ["the", "of", "la", "der", "que"]
    anchors = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', '1', array('{w}'), 1, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP))" for w in words) + " AS a(anchor, version, aliases, min_anchors, valid_from, valid_until)")
    return observe.scan(records, anchors)


MENTIONS = r"""rec AS (SELECT conv_id || ':' || turn AS id, conv_id::VARCHAR AS session, text, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 60) AS ts FROM conversations WHERE role = 'assistant'),
    win AS (SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\s*>')), chr(10)) AS visible FROM rec),
    hit AS (SELECT anchor, id, session, ts::DATE AS day, visible, ts FROM win, (SELECT unnest(['the', 'of', 'la', 'der', 'que']) AS anchor) WHERE regexp_matches(visible, '(?:^|[^\p{L}\p{N}_])' || anchor || '(?:$|[^\p{L}\p{N}_])', 'i')),
    obs AS (SELECT anchor, id, session, day FROM hit QUALIFY row_number() OVER (PARTITION BY anchor, visible, ts ORDER BY id) = 1)"""


@query(f"WITH {MENTIONS} SELECT anchor, id, session, day FROM obs")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).select("anchor", "id", "session", "day")


@query(f"""WITH {MENTIONS} SELECT anchor, count(*) AS mentions, count(DISTINCT session) AS sessions, count(DISTINCT day) AS days, count(DISTINCT session) >= 2 AND count(DISTINCT day) >= 2 AS review_candidate
    FROM obs GROUP BY ALL""")
def mention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.summary(_observed(spark, sf_dir)).drop("version")


@query()
def mention_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in which words of one language's group of aliases stand close together, at any place."""
    anchors = spark.sql("SELECT * FROM VALUES ('en', '1', array('the', 'of', 'and'), 2, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)), ('de', '1', array('der', 'die', 'und'), 3, NULL, NULL) AS a(anchor, version, aliases, min_anchors, valid_from, valid_until)")
    records = _records(spark, sf_dir).filter("role = 'assistant'")
    return observe.scan(records, anchors).select("anchor", "id", "session", "day", "n_aliases")


@query()
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.duplicate_pairs(D.entries(spark, sf_dir).select(F.col("scope").alias("store"), "id", F.concat_ws(" ", "id", "locator", "cost_class").alias("text")), 0.9).withColumn("ratio", F.round("ratio", 9))


@query("""WITH e AS (SELECT event_id, 'item' || (props->>'$.k') AS item_id, ts, event_type, value FROM events),
    uses AS (SELECT event_id, item_id, ts FROM e WHERE event_type IN ('click', 'purchase', 'error')), versions AS (SELECT item_id, ts, event_id AS version, value AS units FROM e WHERE event_type IN ('view', 'signup'))
    SELECT u.event_id, u.item_id, v.version, epoch_us(u.ts) - epoch_us(v.ts) AS age_us, v.units FROM uses u ASOF LEFT JOIN versions v ON u.item_id = v.item_id AND u.ts >= v.ts""")
def uses_asof_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use with the version of its entry that held at its time: views and sign-ups stand for new versions."""
    e = D.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("item"), F.get_json_object("props", "$.k")).alias("item_id"), "ts", "event_type", "value")
    uses = e.filter(F.col("event_type").isin("click", "purchase", "error")).select("event_id", "item_id", "ts")
    versions = e.filter(F.col("event_type").isin("view", "signup")).select("item_id", "ts", F.col("event_id").alias("version"), F.col("value").alias("units"))
    j = asof.as_of(uses, versions, "item_id", "ts")
    return j.select("event_id", "item_id", "version", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("ts_right").cast("timestamp"))).alias("age_us"), "units")


def _stored_days(spark: SparkSession, sf_dir: str) -> str:
    """Daily sketches of all events, stored in three parts; the middle one comes twice."""
    path = scratch.folder(spark)
    events = D.telemetry(spark, sf_dir).withColumn("day", F.to_date("ts"))
    early, late = F.col("day") < "2024-01-11", F.col("day") >= "2024-01-21"
    for part in (events.filter(early), events.filter(~early & ~late), events.filter(~early & ~late), events.filter(late)):
        sketches.update(part, path)
    return path


@query(f"""WITH {EVENTS} SELECT item_id, count(*) AS events, count(*) FILTER ({_D}) AS needs, count(*) FILTER ({_M}) AS misses, coalesce(sum(extra_tokens) FILTER ({_M}), 0)::BIGINT AS miss_extra_tokens,
    count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER ({_D}) AS demand_tasks FROM ev GROUP BY ALL""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tasks by item, merged from daily sketches; items of more than 4,096 tasks are counted from the stored tasks."""
    return sketches.rolled(spark, _stored_days(spark, sf_dir), ["item_id"], exact=True).drop("exact", "miss_rate")


@query(f"""WITH {EVENTS}, d AS (SELECT DISTINCT item_id, task_id FROM ev WHERE {_D} AND item_id IS NOT NULL),
    s AS (SELECT item_id AS seed_id, count(*) AS n FROM d WHERE item_id IN ('item1', 'item2', 'item3') GROUP BY ALL),
    c AS (SELECT a.item_id AS seed_id, b.item_id AS cand_id, count(*) AS support FROM d a JOIN d b USING (task_id) WHERE a.item_id IN ('item1', 'item2', 'item3') AND a.item_id <> b.item_id GROUP BY ALL)
    SELECT s.seed_id, i.item_id AS cand_id, coalesce(support, 0) AS support, round(coalesce(support, 0) / n, 9) AS confidence
    FROM s JOIN (SELECT DISTINCT item_id FROM ev WHERE item_id IS NOT NULL) i ON s.seed_id <> i.item_id LEFT JOIN c ON c.seed_id = s.seed_id AND c.cand_id = i.item_id""")
def sketch_shared_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that each of three seed items shares with every other item, from the intersection of their sketches, or of their tasks where these are too many."""
    path = _stored_days(spark, sf_dir)
    items = sketches.stored(spark, path).filter("item_id IS NOT NULL").select(F.col("item_id").alias("cand_id")).distinct()
    pairs = items.select(F.explode(F.array(*map(F.lit, ("item1", "item2", "item3")))).alias("seed_id"), "cand_id").filter("seed_id <> cand_id")
    return sketches.shared_tasks(spark, path, pairs, exact=True).withColumn("confidence", F.round("confidence", 9))


RULED = r"""rec AS (SELECT conv_id || ':' || turn AS id, conv_id::VARCHAR AS session, role, CASE WHEN turn % 7 = 3 THEN 'Cron' ELSE 'chat' END AS source, coalesce(text, '') AS text, TIMESTAMP '2024-01-01' + to_seconds((conv_id % 10) * 86400 + turn * 60) AS ts,
        conv_id % 3 = 0 AS exposed FROM conversations),
    win AS (SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\s*>')), chr(10)) AS visible FROM rec WHERE role = 'assistant' AND lower(source) <> 'cron'),
    al(anchor, alias, need, fold) AS (VALUES ('fr', 'éau', 2, false), ('fr', 'tion', 2, false), ('de', 'DER', 1, true), ('dots', '. L', 1, false), ('pair', 'la', 2, true), ('pair', ', et', 2, true)),
    split AS (SELECT id, anchor, alias, need, visible, string_split(CASE WHEN fold THEN lower(visible) ELSE visible END, CASE WHEN fold THEN lower(alias) ELSE alias END) AS p FROM win, al),
    raw AS (SELECT id, anchor, alias, need, visible, unnest(list_transform(range(1, len(p)), lambda i: (list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(alias))::INTEGER)) AS s FROM split),
    occ AS (SELECT *, s + length(alias)::INTEGER AS e FROM raw WHERE NOT (regexp_matches(alias[1], '^[A-Za-z0-9]') AND s > 0 AND regexp_matches(substr(visible, s, 1), '^[\p{L}\p{N}_]'))
            AND NOT (regexp_matches(alias[-1], '^[A-Za-z0-9]') AND regexp_matches(substr(visible, s + length(alias)::INTEGER + 1, 1), '^[\p{L}\p{N}_]'))),
    ends AS (SELECT i.id, i.anchor, i.need, i.s, i.e, i.alias FROM occ i JOIN occ j ON i.id = j.id AND i.anchor = j.anchor AND (j.s, j.e, j.alias) <= (i.s, i.e, i.alias) AND i.e - j.s <= 200 GROUP BY i.id, i.anchor, i.need, i.s, i.e, i.alias HAVING count(DISTINCT j.alias) >= i.need
             QUALIFY row_number() OVER (PARTITION BY i.id, i.anchor ORDER BY i.s, i.e, i.alias) = 1),
    firsts AS (SELECT i.id, i.anchor, j.alias, min(row(j.s, j.e)) AS m FROM ends i JOIN occ j ON i.id = j.id AND i.anchor = j.anchor AND (j.s, j.e, j.alias) <= (i.s, i.e, i.alias) AND i.e - j.s <= 200 GROUP BY ALL),
    obs AS (SELECT id, anchor, string_agg(alias || '@' || m[1] || '-' || m[2], ';' ORDER BY m[1], m[2], alias) AS matches FROM firsts GROUP BY ALL)"""


@query(f"""WITH {RULED} SELECT anchor AS entry_id, id AS message_id, session AS session_id, matches, CASE WHEN exposed AND anchor = 'de' THEN 'snapshot_matched' ELSE 'unknown' END AS exposure
    FROM obs JOIN win USING (id) QUALIFY row_number() OVER (PARTITION BY anchor, visible, ts ORDER BY id, session) = 1""")
def mention_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of four anchors over all assistant turns: aliases inside words, of symbols, without case, and two close together."""
    t = D.turns(spark, sf_dir)
    conv, turn = F.col("session").cast("long"), F.col("ord").cast("long")
    records = t.select(
        "id", "session", F.col("speaker").alias("role"), F.when(turn % 7 == 3, "Cron").otherwise("chat").alias("source"), "text", F.timestamp_seconds(F.lit(1704067200) + (conv % 10) * 86400 + turn * 60).alias("ts"),
        F.when(conv % 3 == 0, F.create_map(F.lit("de"), F.lit("1"))).alias("memory_versions"),
    )
    rows = [("fr", ["éau", "tion"], 2, False), ("de", ["DER"], 1, True), ("dots", [". L"], 1, False), ("pair", ["la", ", et"], 2, True)]
    anchors = spark.createDataFrame([(a, "1", al, n, fold, None, None) for a, al, n, fold in rows], "anchor string, version string, aliases array<string>, min_anchors int, case_insensitive boolean, valid_from timestamp, valid_until timestamp")
    found = mentions.observed(records, anchors, "driver", F.lit("2024-02-01").cast("timestamp"), 90)
    shown = F.array_join(F.transform("matches", lambda m: F.format_string("%s@%d-%d", m["anchor"], m["start"], m["end"])), ";")
    return found.select("entry_id", "message_id", "session_id", shown.alias("matches"), "exposure")


@query(f"""WITH {EVENTS}, l AS (SELECT event_id, kind, item_id, extra_tokens, CASE WHEN event_id % 97 = 5 THEN 'unsupported kind' WHEN event_id % 89 = 7 THEN 'a cost is negative' WHEN event_id % 83 = 11 THEN 'expected object' END AS error FROM ev)
    SELECT event_id::VARCHAR AS event_id, kind, item_id, extra_tokens, NULL AS error, 1 AS n FROM l WHERE error IS NULL
    UNION ALL SELECT NULL, NULL, NULL, NULL, error, count(*)::INTEGER FROM l WHERE error IS NOT NULL GROUP BY error
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'duplicate event_id', count(*)::INTEGER FROM l WHERE error IS NULL AND event_id % 50 = 1 HAVING count(*) > 0""")
def telemetry_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of a log, some of them broken and some written twice, read back: events, and how often each error occurs."""
    t = D.telemetry(spark, sf_dir)
    n = F.col("event_id").cast("long")
    cost = F.when(n % 89 == 7, F.lit(-1).cast("long")).otherwise(F.col("extra_tokens"))
    kind = F.when(n % 97 == 5, "use").otherwise(F.col("kind"))
    fields = ["event_id", "task_id", "item_id", "extra_tool_calls", "avoidable"]
    line = F.to_json(F.struct(*fields, kind.alias("kind"), cost.alias("extra_tokens"), F.when(kind == "prefetch", F.coalesce("used", F.lit(False))).alias("used")))
    line = F.when((n % 83 == 11) & (n % 89 != 7) & (n % 97 != 5), F.left(line, F.lit(20))).otherwise(line)
    times = F.when((n % 50 == 1) & (n % 97 != 5) & (n % 89 != 7) & (n % 83 != 11), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    path = scratch.folder(spark)
    t.select(line.alias("value"), F.explode(times).alias("time")).select("value").write.text(path)
    events, errors = readers.telemetry_log(spark, path)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("event_id", "string"), ("kind", "string"), ("item_id", "string"), ("extra_tokens", "bigint"))]
    counted = errors.groupBy(F.regexp_replace("error", r"^(duplicate event_id) .*", "$1").alias("error")).agg(F.count("*").cast("int").alias("n"))
    return events.select("event_id", "kind", "item_id", "extra_tokens", F.lit(None).cast("string").alias("error"), F.lit(1).alias("n")).unionByName(counted.select(*none, "error", "n"))
