"""Operators on small, hand-checked tables."""

import itertools
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from kelpie.operators import dense, economics, evaluate, lexical, observe, planners, policy, ranking, residency, store, telemetry
from kelpie.plans import recall as R
from kelpie.sources import readers
from kelpie.streaming import telemetry as live

DOC = "rowid bigint, id string, scope string, session string, ord int, text string, speaker string, timestamp string, source string, tier string"


def docs_of(spark, *rows):
    """(id, session, ord, text, speaker[, timestamp]) in one scope."""
    return spark.createDataFrame([(i, r[0], "p", r[1], r[2], r[3], r[4], r[5] if len(r) > 5 else "", f"file:{r[1]}", "T1") for i, r in enumerate(rows, 1)], DOC)


@pytest.fixture(scope="module")
def three(spark):
    return docs_of(spark, ("a", "s", 0, "workspace uses the PostgreSQL database", "Alice"), ("b", "s", 1, "runs at port 5432", "Bob"), ("c", "s2", 0, "garden contains trees", "Alice"))


def q(spark, *texts):
    return spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts, 1)], "query_id bigint, scope string, query string")


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_is_sqlites(spark, stem):
    rng = random.Random(11)
    words = "alpha beta gamma delta running runs db 5432 café port-22 the database databases queries".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    metas = [rng.choice(["Alice", "Bob", "Ann alpha"]) for _ in texts]
    asked = [["alpha", "db-5432"], ["port-22", "runs", "cafe"], ["database", "gamma", "zzz"], ["beta"]]
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table t using fts5(a, b, tokenize='{'porter ' if stem else ''}unicode61')")
    db.executemany("insert into t(rowid, a, b) values (?, ?, ?)", [(i, t, m) for i, (t, m) in enumerate(zip(texts, metas, strict=True))])
    docs = spark.createDataFrame([(i, f"{i:03d}", "p", t, m) for i, (t, m) in enumerate(zip(texts, metas, strict=True))], "rowid bigint, id string, scope string, text string, meta string")
    queries = spark.createDataFrame([(i, "p", a) for i, a in enumerate(asked)], "query_id bigint, scope string, terms array<string>")
    got = {}
    for r in lexical.bm25(docs, queries, [("text", 1.0), ("meta", 0.02)], "terms", 100, stem).collect():
        got.setdefault(r.query_id, {})[r.rowid] = r.score
    for i, a in enumerate(asked):
        match = " OR ".join('"' + t + '"' for t in a)
        want = {r: -s for r, s in db.execute("select rowid, bm25(t, 1.0, 0.02) from t where t match ?", (match,))}
        assert got.get(i, {}).keys() == want.keys()
        assert all(got[i][r] == pytest.approx(want[r], abs=1e-6) for r in want)


def test_recall_finds_neighbours_and_keeps_budget(spark, three):
    got = R.recall(three, q(spark, "Which database does the workspace use?"), "sparse", 600, reach=1).first()
    assert got.selected_ids == ["a", "b"] and got.budget_used == len(got.context.encode())
    tiny = R.recall(three, q(spark, "Which database does the workspace use?"), "sparse", 60, reach=1).first()
    assert tiny.budget_used <= 60
    with pytest.raises(ValueError):
        R.recall(three, q(spark, "x"), "sparse", k=5000)


def test_scopes_are_isolated(spark, three):
    other = three.withColumn("scope", F.lit("other")).withColumn("rowid", F.col("rowid") + 10).withColumn("id", F.concat(F.lit("o"), "id"))
    got = R.recall(three.union(other), q(spark, "database"), "literal").first()
    assert got.selected_ids == ["a"]


def test_special_characters_are_safe(spark, three):
    for text in ('"', "a OR (b", "NEAR/2 *", "", "''; drop"):
        R.recall(three, q(spark, text), "sparse").collect()


def test_pack_skips_what_does_not_fit_like_a_loop(spark):
    rng = random.Random(31)
    for budget in (0, 128, 600):
        rows = [(1, i, f"d{i}", "Zoë", "", "x" * rng.randint(1, 300)) for i in range(15)]
        got = ranking.pack(spark.createDataFrame(rows, "query_id bigint, rank int, id string, speaker string, timestamp string, text string"), budget).first()
        blocks, used = [], 0
        for _, _, i, s, t, text in rows:
            b = f"[source {json.dumps({'id': i, 'speaker': s, 'date': t}, ensure_ascii=False)}]\n{text}"
            n = used + len(b.encode()) + (2 if blocks else 0)
            if n <= budget:
                used, blocks = n, [*blocks, (i, b)]
        assert (got.selected_ids, got.context, got.budget_used) == ([i for i, _ in blocks], "\n\n".join(b for _, b in blocks), used)


def test_dense_ties_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "rowid bigint, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "query_id bigint, vector array<double>")
    got = sorted((r.query_id, r.rank, r.rowid) for r in dense.top_k(v, queries, 3).collect())
    assert got == [(1, 1, 2), (1, 2, 5), (1, 3, 8), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 1, 0), (3, 2, 3), (3, 3, 6)]
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 1)
    assert sorted((r.query_id, r.rank, r.rowid) for r in dense.top_k(v, queries, 3).collect()) == got
    assert dense.top_k(v, queries.limit(0), 3).count() == 0


def test_vectors_must_be_usable(spark):
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0], [float("inf")]):
        with pytest.raises(Exception):  # noqa: B017  Spark wraps the assertion
            spark.createDataFrame([(bad,)], "v array<double>").select(dense.normalised(F.col("v"))).collect()


def test_rrf_ties_by_row(spark):
    c = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 3, 1), (1, "a", 3, 2)], "query_id bigint, channel string, rowid bigint, rank int")
    assert [(r.rowid, r.rank) for r in ranking.rrf(c).orderBy("rank").collect()] == [(3, 1), (7, 2)]


def test_temporal_operators(spark):
    d = docs_of(
        spark, ("a", "s", 0, "release shipped", "x", "2024-03-10"), ("b", "s", 1, "release shipped", "x", "2024-05-02"), ("c", "s", 2, "release shipped", "x", "2025-01-01"), ("d", "s", 3, "garden", "x", "2026-01-01")
    )
    rows = d.withColumn("query_id", F.lit(1)).withColumn("rank", F.col("ord") + 1)

    def order(text):
        r = ranking.temporal_reorder(rows, q(spark, text)).join(d, "rowid").orderBy("rank").collect()
        return "".join(x.id for x in r)

    assert order("which release came after 2024-05-01") == "bcad"
    assert order("which release came before May 2024") == "abcd"
    assert order("latest release") == "cbad" and order("first release") == "abcd"
    assert order("release between 2024-04 and 2024-06") == "bacd"
    assert order("release in March") == "abcd" and order("release of 2025") == "cabd"
    assert order("release") == "abcd"


HINT_CASES = [
    ("When was it, May 2026?", "WHEN", None, ["2026-05-01"], ["month"], [5]),
    ("on 2025-02-29", None, None, [], [], []),
    ("3 May 4 2024", None, None, [], [], []),
    ("before 3rd March 2021 or 2020-05-06, in 2019", None, "before", ["2021-03-03", "2020-05-06", "2019-01-01"], ["day", "day", "year"], [3]),
    ("31 June 2020 and 2019", None, None, [], [], []),
    ("March 5, 2020 between MAY 2021", None, "between", ["2020-03-05", "2021-05-01"], ["day", "month"], [3, 5]),
    ("2021-13 or 1999-12 or 12345 or 2020x", None, None, ["1999-12-01"], ["month"], []),
    ("who came first, in June or in june", "WHO", "first", [], [], [6]),
    ("x" * 16_001 + " 2020", None, None, [], [], []),
    (None, None, None, [], [], []),
    ("⟦05⟧ 2020", None, None, ["2020-01-01"], ["year"], []),
]


def test_hints_of_queries(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(HINT_CASES)], "i int, query string")
    got = {r.i: r.h for r in df.select("i", ranking.hints(F.col("query")).alias("h")).collect()}
    for i, (_, kind, temporal, dates, precisions, months) in enumerate(HINT_CASES):
        h = got[i]
        assert (h.kind, h.temporal, h.dates, h.precisions, h.months) == (kind, temporal, dates, precisions, months), HINT_CASES[i]
    df = spark.createDataFrame([("cats AND dogs",), ("see db-5432 OR\nb.c/d",), ("plain",)], "query string")
    got = [r.h for r in df.select(ranking.hints(F.col("query")).alias("h")).collect()]
    assert [(h.joined, h.operands, h.identifiers) for h in got] == [("AND", ["cats", "dogs"], []), ("OR", ["see db-5432", "b.c/d"], ["db-5432", "b.c/d"]), (None, [], [])]


def test_stamps(spark):
    values = {"2024-05-06": "2024-05-06", " 2024-05-06T10:11:12Z": "2024-05-06", "2024-05-06 10:11+02:00": "2024-05-06", "on 6 May 2024, at noon": "2024-05-06", "in May 2024": None, "2024-02-30": None, "": None}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r.v: str(r.d) if r.d else None for r in df.select("v", ranking.stamp(F.col("v")).alias("d")).collect()} == values


def test_entities_move_up_but_membership_stays(spark):
    d = docs_of(spark, ("a", "s", 0, "nothing", "Annette"), ("b", "s", 1, "see bug-42", "Bob"), ("c", "s", 2, "fixed BUG-42 today", "Bob"), ("d", "s", 3, "hello", "Ann"))
    rows = d.withColumn("query_id", F.lit(1)).withColumn("rank", F.col("ord") + 1)
    ids = lambda t: [r.rowid for r in ranking.entity_reorder(rows, q(spark, t)).orderBy("rank").collect()]
    assert ids("who fixed BUG-42?")[0] == 3 and sorted(ids("who fixed BUG-42?")) == [1, 2, 3, 4]
    assert ids("what did Ann say")[0] == 4 and ids("nothing known") == [1, 2, 3, 4]


def test_associations_and_aliases(spark, three):
    seeds = spark.createDataFrame([(1, 1, 1)], "query_id bigint, rowid bigint, rank int")
    edges = {(r.from_id, r.to_id, r.relation) for r in ranking.association(seeds, three).collect()}
    assert edges == {("a", "c", "same-explicit-speaker"), ("a", "b", "same-source")}
    alias = spark.createDataFrame([("the boss", "Alice")], "alias string, canonical string")
    assert {r.rowid for r in ranking.alias_channel(three, q(spark, "what says the boss"), alias).collect()} == {1, 3}
    assert {r.rowid for r in ranking.alias_channel(three, q(spark, "what says bob")).collect()} == {2}


def test_second_hop_and_edge_cap(spark):
    d = docs_of(spark, ("a", "s", 0, "x", "P"), ("b", "s", 1, "y", "Q"), ("c", "t", 0, "z", "Q"), ("d", "u", 0, "see a", "R")).withColumn("source", F.lit(""))
    seeds = spark.createDataFrame([(1, 1, 1)], "query_id bigint, rowid bigint, rank int")
    got = sorted((r.hop, r.from_id, r.to_id, r.relation) for r in ranking.associations(seeds, d).collect())
    assert got == [(1, "a", "b", "session-adjacency"), (2, "b", "c", "same-explicit-speaker")]
    assert ranking.associations(seeds, d, 2, 1).count() == 1
    from_d = spark.createDataFrame([(1, 4, 1)], "query_id bigint, rowid bigint, rank int")
    assert ranking.associations(from_d, d, 1).first().relation == "explicit-identifier-reference"


def test_references_are_whole_words(spark):
    d = docs_of(spark, ("a", "s", 0, "see b:2. Not c:21, but (D-4)", "P"), ("b:2", "t", 0, "y", "Q"), ("c:2", "u", 0, "z", "R"), ("d-4", "v", 0, "w", "S")).withColumn("source", F.lit(""))
    seeds = spark.createDataFrame([(1, 1, 1)], "query_id bigint, rowid bigint, rank int")
    assert sorted(r.to_id for r in ranking.association(seeds, d).collect()) == ["b:2", "d-4"]


def test_two_scopes_share_a_budget(spark):
    rows = lambda ids, n: spark.createDataFrame([(1, k, i, "", "", "x" * n) for k, i in enumerate(ids)], "query_id bigint, rank int, id string, speaker string, timestamp string, text string")
    for budget in (150, 300, 700, 3000):
        r = ranking.pack_two_scopes(rows("ab", 60), rows("cdefg", 60), budget).first()
        assert r.budget_used == len(r.context.encode()) <= budget
    assert r.live_ids == ["a", "b"] and r.base_ids == list("cdefg")


def test_adjacent_and_value_order(spark, three):
    rows = spark.createDataFrame([(1, 3, 1), (1, 1, 2)], "query_id bigint, rowid bigint, rank int")
    order = lambda df: [r.rowid for r in df.orderBy("rank").collect()]
    assert order(ranking.adjacent(rows, three)) == [3, 1, 2]
    sized = rows.withColumn("units", F.when(F.col("rowid") == 3, 400).otherwise(100))
    assert order(ranking.value_order(sized, F.col("units"))) == [1, 3]


def test_segments_are_slices(spark):
    text = "First sentence here. The database moved to port 5432. Last words of it."
    d = docs_of(spark, ("a", "s", 0, text * 1, "x"))
    rows = d.withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(1))
    got = ranking.pack_segments(rows, q(spark, "database port"), 100).first()
    assert got.segment in text and "5432" in got.segment and not got.complete
    assert ranking.pack_segments(rows, q(spark, "database port"), 2000).first().complete


EV = "event_id string, task_id string, kind string, item_id string, extra_tokens bigint, extra_tool_calls bigint, extra_latency_ms double, extra_cost_usd double, avoidable boolean, used boolean, avoided_miss boolean, avoided_extra_tokens bigint"
EVENTS = [
    ("1", "t1", "resident_hit", "a", 0, 0, 0.0, 0.0, None, None, None, 0), ("2", "t1", "resident_miss", "b", 100, 1, 20.0, 0.01, True, None, None, 0),
    ("3", "t2", "hard_miss", "c", 50, 0, 30.0, 0.02, False, None, None, 0), ("4", "t2", "prefetch", "d", 40, 0, 0.0, 0.004, None, False, None, 0), ("5", "t3", "prefetch", "e", 20, 0, 0.0, 0.002, None, True, None, 0),
]


def test_telemetry_rates(spark):
    t = telemetry.totals(telemetry.checked(spark.createDataFrame(EVENTS, EV))).first()
    assert (t.resident_miss_rate, t.hard_miss_rate, t.avoidable_miss_rate) == pytest.approx((2 / 3, 1 / 3, 1 / 3))
    assert (t.miss_extra_tokens, t.miss_extra_tool_calls, t.miss_extra_latency_ms) == (150, 1, 50.0) and t.prefetch_accuracy == 0.5 and t.unused_injected_tokens == 40
    only = telemetry.totals(spark.createDataFrame(EVENTS[3:], EV)).first()
    assert only.resident_miss_rate is None and only.hard_miss_rate is None
    assert telemetry.duplicate_ids(spark.createDataFrame(EVENTS + EVENTS[:1], EV)).first().event_id == "1"


@pytest.mark.parametrize("change", [{4: -1}, {2: "other"}, {2: "prefetch", 9: None}, {3: None}])
def test_telemetry_is_checked(spark, change):
    row = list(EVENTS[1])
    for k, v in change.items():
        row[k] = v
    with pytest.raises(Exception):  # noqa: B017
        telemetry.checked(spark.createDataFrame([tuple(row)], EV)).collect()


def test_budget_controller_holds_on_unavoidable_misses(spark):
    events = [(str(i), f"t{i}", "hard_miss", "a", 1, 0, 0.0, 0.0, False, None, None, 0) for i in range(10)]
    t = telemetry.totals(spark.createDataFrame(events, EV))
    step = telemetry.budget_step(t, 200, 0.2, least=100, most=500, step=50, min_demands=10, miss_target=0.1, hysteresis=0.02).first()
    assert (step.action, step.suggested_budget) == ("hold", 200)
    avoidable = telemetry.totals(spark.createDataFrame([(*e[:8], True, *e[9:]) for e in events], EV))
    grow = telemetry.budget_step(avoidable, 500, 0.2, least=100, most=500, step=50, min_demands=10).first()
    assert (grow.action, grow.suggested_budget) == ("hold_at_bound", 500)


USE = "entry_id string, event_id string, type string, t date"


def test_activity_rules(spark):
    import datetime as dt

    d = dt.date
    ev = [("a", str(i), "hit", d(2026, 9, 1)) for i in range(10)] + [("old", "x", "hit", d(2026, 1, 1)), ("seen", "y", "mention_observed", d(2026, 9, 5))]
    now = F.lit("2026-09-06").cast("date")
    got = {r.entry_id: r.activity for r in policy.activity(spark.createDataFrame(ev, USE), now).collect()}
    assert got["a"] == pytest.approx(2.0 * (1 + 5 / 10) ** -0.5) and got["old"] == 0 and "seen" not in got
    legacy = {r.entry_id: r.activity for r in policy.activity(spark.createDataFrame(ev, USE), now, "legacy").collect()}
    assert legacy["old"] > 0


BAD_USES = {
    "type": ("a", "9", "clicked", "2026-09-01", "seen", False),
    "no type": ("a", "9", None, "2026-09-01", "seen", False),
    "future": ("a", "9", "hit", "2026-09-07", "seen", False),
    "no day": ("a", "9", "hit", None, "seen", False),
    "no id": ("a", None, "hit", "2026-09-01", "seen", False),
    "empty id": ("a", "", "hit", "2026-09-01", "seen", False),
    "twice": ("a", "1", "hit", "2026-09-02", "seen", False),
    "bare": ("a", "9", "confirm", "2026-09-01", " ", False),
    "no mark": ("a", "9", "confirm", "2026-09-01", None, None),
}


def uses_of(spark, *rows):
    return spark.createDataFrame(rows, "entry_id string, event_id string, type string, t string, evidence string, legacy_unverified boolean").withColumn("t", F.to_date("t"))


def test_activity_events_are_checked(spark):
    now = F.lit("2026-09-06").cast("date")
    good = [("a", "1", "hit", "2026-09-06", None, None), ("b", "1", "hit", "2026-09-01", None, None), ("a", "2", "confirm", "2026-09-01", None, True), ("a", "3", "confirm", "2026-09-01", "seen", None)]
    got = policy.checked_uses(uses_of(spark, *good), now).collect()
    assert sorted((r.entry_id, r.event_id) for r in got) == [("a", "1"), ("a", "3"), ("b", "1")]
    assert policy.checked_uses(uses_of(spark, *good).drop("evidence", "legacy_unverified"), now).count() == 4
    assert policy.checked_uses(uses_of(spark, *good).limit(0), now).count() == 0


@pytest.mark.parametrize("why", BAD_USES)
def test_a_wrong_activity_event_is_an_error(spark, why):
    rows = [("a", "1", "hit", "2026-09-01", None, None), BAD_USES[why]]
    with pytest.raises(Exception, match="invalid activity event"):
        policy.checked_uses(uses_of(spark, *rows), F.lit("2026-09-06").cast("date")).collect()


def test_pack_with_a_counter(spark):
    rows = spark.createDataFrame([(1, 1, "a", "", "", "one two three"), (1, 2, "b", "", "", "x " * 40), (1, 3, "c", "", "", "four"), (2, 1, "d", "", "", "y " * 90)], "query_id long, rank int, id string, speaker string, timestamp string, text string")
    words = lambda text: len(text.split())
    got = {r.query_id: r for r in ranking.pack(rows, 4, F.col("text"), counter=words).collect()}
    assert (got[1].selected_ids, got[1].context, got[1].budget_used) == (["a", "c"], "one two three\n\nfour", 4)
    assert (got[2].selected_ids, got[2].context, got[2].budget_used) == ([], "", 0)
    assert [r.budget_used for r in ranking.pack(rows, 4, F.col("text"), limits=spark.createDataFrame([(1, 3)], "query_id long, limit long"), counter=words).orderBy("query_id").collect()] == [3, 0]
    as_bytes = lambda text: len(text.encode())
    assert sorted(map(tuple, ranking.pack(rows, 60, counter=as_bytes).collect())) == sorted(map(tuple, ranking.pack(rows, 60).collect()))
    with pytest.raises(Exception, match="positive integer"):
        ranking.pack(rows, 4, counter=lambda text: 0).collect()


def test_prefetch_guards(spark):
    import datetime as dt

    items = spark.createDataFrame(
        [("s", ["1", "2", "3"], 4.0), ("thin", ["1"], 1.0), ("ok", ["1", "2"], 5.0), ("own", ["2", "3"], 5.0), ("hot", ["1", "2"], 1.0), ("late", ["1", "2"], 1.0), ("off", ["1", "2"], 1.0), ("away", ["1", "2"], 1.0), ("alien", ["1", "2"], 1.0)],
        "item_id string, demand_task_ids array<string>, avg_avoidable_extra_tokens double",
    )
    day = dt.date(2024, 6, 1)
    e = [(i, "T1", "w/a.md", "active", None, None) for i in ("s", "thin", "ok")] + [("own", "T1", "w/a.md", "active", None, 9.0), ("hot", "T0", "w/a.md", "active", None, None)]
    e += [("late", "T1", "w/a.md", "active", day, None), ("off", "T1", "w/a.md", "invalid", None, None), ("away", "T1", "../a.md", "active", None, None)]
    entries = spark.createDataFrame([(*x, None, "N.md") for x in e], "id string, tier string, locator string, status string, valid_from date, miss_penalty_tokens double, valid_until date, store string")
    seeds = spark.createDataFrame([("s",), ("thin",)], "item_id string")
    p = telemetry.prefetch_plan(items, seeds, 2, 0.5, None, entries, F.lit("2024-03-01").cast("date"))
    assert sorted((r.item_id, r.seed_id, r.support, r.penalty) for r in p.collect()) == [("ok", "s", 2, 5.0), ("own", "s", 2, 9.0)]
    assert {r.item_id for r in telemetry.prefetch_plan(items, seeds, 2, 0.5, None).collect()} == {"ok", "own", "hot", "late", "off", "away", "alien"}


def test_greedy_plan_pins_first(spark):
    schema = "id string, pinned boolean, resident_units int, cost_class string, activity double"
    plan = lambda rows, b: policy.greedy_plan(spark.createDataFrame(rows, schema), b).first()
    p = plan([("a", False, 4, "low", 8.0), ("b", True, 3, "low", 0.0), ("c", False, 9, "high", 90.0), ("d", False, 2, "med", 0.0), ("e", False, 3, "low", 1.0)], 10)
    assert (p.status, p.selected, p.budget_used) == ("OK", ["b", "a", "e"], 10)
    assert plan([("a", True, 10, "low", 1.0)], 1).status == "PINNED_OVER_BUDGET"


def test_exact_selection_beats_density(spark):
    assert residency.best_subset([("a", 6, 10.0, 0, 0), ("b", 4, 6.0, 0, 0), ("c", 4, 6.0, 0, 0)], 8) == ["b", "c"]
    rng = random.Random(1)
    for _ in range(40):
        items = [(f"i{k}", rng.randint(1, 9), float(rng.randint(1, 9)), float(rng.randint(0, 2)), rng.randint(0, 1)) for k in range(7)]
        cap = rng.randint(1, 25)
        best = max(sum(i[2] for i in s) for n in range(8) for s in itertools.combinations(items, n) if sum(i[1] for i in s) <= cap)
        chosen = residency.best_subset(items, cap)
        assert sum(i[2] for i in items if i[0] in chosen) == best and sum(i[1] for i in items if i[0] in chosen) <= cap
    with pytest.raises(ValueError):
        residency.best_subset([("a", 1, 1.0, 0, 0)], 200_000)


def test_shadow_plan_statuses(spark):
    schema = "id string, tier string, pinned boolean, units bigint, stale bigint, basis string, penalty double, expected_misses double, saved double, carry bigint, net double, uncertain boolean"
    rows = [("a", "T0", True, 5, 0, "x", 1.0, 1.0, 1.0, 1, -1.0, False), ("b", "T0", False, 5, 1, "x", 1.0, 1.0, 1.0, 1, 9.0, False), ("c", "T1", False, 3, 0, "x", 1.0, 1.0, 1.0, 1, 4.0, False)]
    df = spark.createDataFrame(rows, schema)
    p = residency.shadow_plan(df, 10, 50).first()
    assert (p.status, p.selected, p.admit, p.evict, p.retain) == ("OK", "a,c", "c", "b", "a")
    few = residency.shadow_plan(df, 10, 3).first()
    assert (few.status, few.selected, few.admit, few.provisional_selected) == ("INSUFFICIENT_TELEMETRY", "a,b", "", "a,c")
    assert residency.shadow_plan(df, 2, 50).first().status == "PROTECTED_OVER_BUDGET"


def test_replay_scores_before_it_observes(spark):
    import datetime as dt

    uses = spark.createDataFrame([("g", "e1", "a", dt.date(2026, 1, 1)), ("g", "e2", "a", dt.date(2026, 1, 2))], "grp string, event_id string, entry_id string, t date")
    entries = spark.createDataFrame([("a", 5, "low", False), ("b", 5, "low", False)], "id string, resident_units int, cost_class string, pinned boolean")
    r = policy.replay(uses, entries, 10).first()
    assert (r.requests, r.hits, r.hit_rate) == (2, 1, 0.5)


def test_mentions(spark):
    rec = "id string, session string, role string, text string, ts timestamp"
    import datetime as dt

    at = lambda d: dt.datetime(2026, 9, d)
    rows = [
        ("1", "s1", "assistant", "use Project Alpha here", at(2)), ("2", "s2", "assistant", "use Project Alpha here", at(2)), ("3", "s1", "user", "Project Alpha", at(2)),
        ("4", "s1", "assistant", "> Project Alpha\n```\nProject Alpha\n```", at(3)), ("5", "s3", "assistant", "PROJECT ALPHA again", at(4)), ("6", "s1", "assistant", "Alpha" + "x" * 300 + " Project", at(4)),
    ]
    anchors = spark.createDataFrame([("p", "1", ["project alpha"], 1, None, None), ("two", "1", ["alpha", "project"], 2, None, None), ("new", "1", ["alpha"], 1, at(20), None)], "anchor string, version string, aliases array<string>, min_anchors int, valid_from timestamp, valid_until timestamp")
    now = F.lit("2026-09-06").cast("timestamp")
    records = spark.createDataFrame(rows, rec)
    obs = observe.scan(observe.windowed(records, now, 30), anchors)
    got = sorted((r.anchor, r.id) for r in obs.collect())
    assert got == [("p", "1"), ("p", "5"), ("two", "1"), ("two", "5")]  # the copy in another session is one event
    s = {r.anchor: (r.mentions, r.sessions, r.days, r.review_candidate) for r in observe.summary(obs).collect()}
    assert s["p"] == (2, 2, 2, True) and observe.new_only(obs, obs).count() == 0
    assert {r.reason: r.n for r in observe.skipped(records, now, 30).collect()} == {"role": 1, "scanned": 5}


def test_metrics_cases(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id bigint, id string")
    packed = spark.createDataFrame([(1, ["x", "a"], 10)], "query_id bigint, selected_ids array<string>, budget_used bigint")
    r = evaluate.judged(packed, gold, gold).first()
    assert (r.hits, r.n_gold, r.candidate_hits, r.reciprocal_rank) == (1, 2, 2, 0.5)
    m = evaluate.metrics(evaluate.judged(packed, gold, gold)).first()
    assert (m.scorable, m.macro_recall, m.all_gold, m.any_gold) == (1, 0.5, 0.0, 1.0)


def test_paired_needs_equal_keys(spark):
    a = spark.createDataFrame([(1, 1), (2, 0)], "k int, v int")
    assert sorted(r.outcome for r in evaluate.paired(a, a.withColumn("v", F.lit(1)), ["k"], "v").collect()) == ["tie", "win"]
    with pytest.raises(Exception):  # noqa: B017
        evaluate.paired(a, a.filter("k = 1"), ["k"], "v").collect()


def test_skyline_and_gates(spark):
    rows = spark.createDataFrame([("a", "g", 1.0, 9.0), ("b", "g", 2.0, 2.0), ("c", "g", 3.0, 3.0), ("d", "g", None, 1.0), ("e", "h", 9.0, 9.0)], "k string, g string, x double, y double")
    assert sorted(r.k for r in planners.skyline(rows, "k", ["x", "y"], ["g"]).collect()) == ["a", "b", "d", "e"]
    s = [("w", c, base + 0.01 * i) for c, base in (("base", 100.0), ("fast", 50.0), ("near", 99.0)) for i in range(5)]
    g = {r.candidate: r.accepted for r in planners.gain_gate(spark.createDataFrame(s, "workload string, candidate string, ms double"), "base").collect()}
    assert g == {"fast": True, "near": False}
    one_null = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "g string, ms double")
    assert {r.g: r.median for r in planners.summary(one_null, "g").collect()} == {"a": None, "b": 3.0}


def test_costs_need_every_scope(spark):
    rows = spark.createDataFrame([("s", "m", 600, 100, 1)], "scope string, mode string, budget int, budget_used int, hits int")
    full = spark.createDataFrame([("s", 1000)], "scope string, full_tokens int")
    c = {r.rho: (r.cost, r.full_ratio) for r in economics.cohort_costs(rows, full, 2.0, 0.2).collect()}
    assert c[0.0] == pytest.approx((0.0002, 10.0))
    with pytest.raises(Exception):  # noqa: B017
        economics.cohort_costs(rows, full.filter("scope = 'x'"), 2.0, 0.2).collect()


def test_scopes_are_replaced_whole(spark, three, tmp_path):
    path = str(tmp_path / "docs")
    both = three.unionByName(three.withColumn("scope", F.lit("q")))
    store.write_scopes(both, path)
    store.write_scopes(three.filter("id = 'a'"), path)
    got = sorted((r.scope, r.id) for r in spark.read.parquet(path).collect())
    assert got == [("p", "a"), ("q", "a"), ("q", "b"), ("q", "c")]
    with pytest.raises(Exception):  # noqa: B017
        store.write_scopes(three.union(three), path)
    assert sorted((r.scope, r.id) for r in spark.read.parquet(path).collect()) == got
    prints = lambda df: {(r.scope, r.fingerprint, r.n) for r in store.fingerprint(df).collect()}
    assert prints(three) == prints(three.repartition(3)) != prints(three.filter("id <> 'a'"))


def test_placements_are_versioned(spark, tmp_path):
    path, state = str(tmp_path / "placement"), lambda t: spark.createDataFrame([("a", t)], "id string, tier string")
    assert store.latest_revision(spark, path) == 0
    assert store.commit(spark, path, state("T1"), 0) == 1 and store.commit(spark, path, state("T0"), 1) == 2
    with pytest.raises(ValueError):
        store.commit(spark, path, state("T2"), 1)
    assert store.rollback(spark, path, 1) == 3 and store.revision(spark, path, 3).first().tier == "T1"
    placed = spark.createDataFrame([("a", "T1", 500), ("b", "T0", 5), ("c", "T0", 500)], "id string, tier string, moved_s_ago int")
    wanted = spark.createDataFrame([("a", "T0", 5.0), ("b", "T1", 9.0), ("c", "T0", 0.0), ("z", "T0", 1.0)], "id string, tier string, gain double")
    assert {r.id: (r.move, r.held_by) for r in store.propose(placed, wanted).collect()} == {"a": ("admit", None), "b": ("evict", "cooldown"), "c": ("keep", None), "z": ("unknown_entry", None)}


def test_readers(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_text('{"id":"a","scope":"p","session":"s","ord":0,"text":"hi","speaker":"x","timestamp":"","source":"m","tier":"T1"}\n')
    assert readers.jsonl_documents(spark, str(tmp_path / "docs.jsonl"), "p").first().id == "a"
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl_documents(spark, str(tmp_path / "docs.jsonl"), "q").collect()
    md = tmp_path / "notes"
    (md / "sub").mkdir(parents=True)
    (md / "sub/x.md").write_text("intro\n# One\nbody\n§\n\n§\nlast\n")
    (md / "y.txt").write_text("no")
    got = [(r.id, r.text) for r in readers.markdown_documents(spark, str(md), "p").orderBy("ord").collect()]
    assert [t for _, t in got] == ["intro", "# One\nbody", "last"] and got[0][0] == "file:sub/x.md#0" and got[2][0].endswith("#3")
    assert [(r.name, r.first) for r in readers.file_manifest(spark, str(md / "sub")).collect()] == [("x.md", "intro")]
    (tmp_path / "s.json").write_text(json.dumps({"sample_id": "c1", "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "hello"}], "session_1_date_time": "1 May 2024", "speaker_a": "A"}, "qa": [{"question": "?", "evidence": ["D1:1; D1:2"], "category": 5}]}))
    t = readers.session_tasks(spark, str(tmp_path / "s.json")).first()
    assert (t.gold, t.malformed, t.diagnostic) == (["c1/D1:1", "c1/D1:2"], False, True)
    r = readers.sessions_file(spark, str(tmp_path / "s.json"), "p").first()
    assert (r.id, r.text, r.timestamp) == ("c1/D1:1", "hello", "1 May 2024")
    (tmp_path / "h.json").write_text(json.dumps([{"question_id": "q", "question": "?", "haystack_session_ids": ["x", "x"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]]}]))
    assert sorted((r.session, r.text) for r in readers.haystack_file(spark, str(tmp_path / "h.json")).collect()) == [("x", "user: a"), ("x~1#1", "user: b")]
    assert {(r.session == r.id, r.ord) for r in readers.haystack_file(spark, str(tmp_path / "h.json"), own_sessions=True).collect()} == {(True, 0)}
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "chat": [{"turns": [[{"role": "user", "content": "a"}], [{"role": "assistant", "content": "b"}]]}]}]))
    assert [r.text for r in readers.batched_chat_file(spark, str(tmp_path / "b.json")).orderBy("ord").collect()] == ["user: a", "assistant: b"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "trajectories": [{"id": "j", "goal": "g", "start_url": "u", "states": [{"url": "u", "accessibility_tree": "t", "action": "c"}]}]}]))
    assert readers.trajectories_file(spark, str(tmp_path / "t.json")).first().text == "u\nt\nc"
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "questions": ["q1", "q2"], "answers": ["a1", "a2"], "backgrounds": ["b1", "b2"]}]))
    assert [(r.n, r.question, r.background) for r in readers.subtasks_file(spark, str(tmp_path / "a.json")).orderBy("n").collect()] == [(0, "q1", "b1"), (1, "q2", "b2")]
    entries = readers.store_entries(spark.createDataFrame([("m", "one\n§\ntwo\nmore\n§\n\n")], "store string, text string"))
    assert [(r.line, r.text) for r in entries.orderBy("line").collect()] == [(1, "one"), (3, "two\nmore")]
    (tmp_path / "i.json").write_text(json.dumps({"version": 2, "revision": 7, "entries": [{"id": "e", "tier": "T0", "status": "active", "events": [{"event_id": "1", "type": "hit", "t": "2026-01-01"}]}]}))
    e = readers.index_entries(spark, str(tmp_path / "i.json"))
    assert e.first().revision == 7 and readers.use_chronology(e, spark.createDataFrame([("e",)], "id string")).first().event_id == "1"
    (tmp_path / "c.json").write_text(json.dumps({"entries": {"e": {"resident_units": 5, "locator": "warm/e.md"}}}))
    o = readers.overlaid(e, readers.catalog(spark, str(tmp_path / "c.json"))).first()
    assert (o.resident_units, o.locator) == (5, "warm/e.md")


def test_chat_messages(spark):
    m = spark.createDataFrame([(1, "s", "user", "a", 10.0, 1, 0), (2, "s", "user", "b", 11.0, 0, 0), (3, "s", "assistant", "c", 12.0, 1, 1)], "id bigint, session_id string, role string, content string, timestamp double, active int, _compressed_summary int")
    s = spark.createDataFrame([("s", "cli", 0, "p")], "id string, source string, hidden int, profile_name string")
    page, info = readers.chat_messages(m, s, F.timestamp_seconds(F.lit(100)))
    assert [r.content for r in page.collect()] == ["a"] and not info.first().partial
    d = readers.message_documents(page, "p").first()
    assert (d.id, d.ord, d.speaker) == ("msg:1", 0, "user")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), "stream_out"
    rows = [("1", "a", "resident_miss", 5, "2026-01-01 00:00:00"), ("1", "a", "resident_miss", 5, "2026-01-01 00:00:00"), ("2", "a", "resident_hit", 0, "2026-01-01 00:10:00"), ("3", "b", "hard_miss", 2, "2026-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "event_id string, item_id string, kind string, extra_tokens bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    once = live.deduplicated(stream, "1 day").writeStream.format("memory").queryName(out).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    once.awaitTermination(120)
    assert spark.table(out).count() == 3
    gaps = live.last_use_gaps(stream).writeStream.format("memory").queryName("gaps").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    gaps.awaitTermination(120)
    assert {r.item_id: (r.uses, r.longest_gap_s) for r in spark.table("gaps").collect()} == {"a": (3, 600.0), "b": (1, 0.0)}
    roll = live.rolling(stream, "1 hour").writeStream.format("memory").queryName("roll").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    roll.awaitTermination(120)
    assert {r.item_id: (r.needs, r.misses) for r in spark.table("roll").collect()} == {"a": (3, 2), "b": (1, 1)}
