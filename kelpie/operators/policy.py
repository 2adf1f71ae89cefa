"""Activity, greedy plans, replay, audits and directories of index entries."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def current(now: Column) -> Column:
    """Active, and within [valid_from, valid_until)."""
    return (F.col("status") == "active") & F.coalesce(F.col("valid_from") <= now, F.lit(True)) & F.coalesce(now < F.col("valid_until"), F.lit(True))


def checked_uses(events: DataFrame, now: Column) -> DataFrame:
    """Each event once, failing at run time on an unknown type, a day that is missing or after ``now``, an event id that is missing or
    met twice in an entry, or a confirmation without evidence.

    ``events`` has (entry_id, event_id, type, t); without a column ``evidence`` confirmations are not asked for it. A confirmation
    marked ``legacy_unverified`` needs none, and counts for nothing.
    """
    have = events.columns
    spoken = F.coalesce(F.trim("evidence") != "", F.lit(False)) if "evidence" in have else F.lit(True)
    legacy = F.coalesce(F.col("legacy_unverified"), F.lit(False)) if "legacy_unverified" in have else F.lit(False)
    bare = F.coalesce(F.col("type") == "confirm", F.lit(False)) & ~spoken
    bad = F.coalesce(~F.col("type").isin(*S.WEIGHTS) | (F.col("t") > now), F.lit(True)) | F.coalesce(F.col("event_id") == "", F.lit(True)) | (bare & ~legacy)
    once = events.select("entry_id", "event_id", "type", "t", bad.alias("bad"), bare.alias("bare")).groupBy("entry_id", "event_id")
    e = once.agg(F.first("type").alias("type"), F.first("t").alias("t"), F.bool_or("bad").alias("bad"), F.bool_or("bare").alias("bare"), F.count("*").alias("n"))
    sound = F.assert_true(~F.col("bad") & (F.col("n") == 1), F.lit("invalid activity event")).isNull()
    return e.filter(sound & ~F.col("bare")).select("entry_id", "event_id", "type", "t")


def daily(events: DataFrame, now: Column) -> DataFrame:
    """(entry_id, age, weight): weights by entry and day; weightless events drop out."""
    weight = S.case_of(F.col("type"), S.WEIGHTS)
    return events.select("entry_id", F.datediff(now, F.col("t")).alias("age"), weight.alias("w")).filter("w > 0").groupBy("entry_id", "age").agg(F.sum("w").alias("weight"))


def activity(events: DataFrame, now: Column, kernel: str = "bounded_power", half_life: float = 30.0, exponent: float = 0.5, window_days: int = 180, daily_cap: float = 2.0) -> DataFrame:
    """(entry_id, activity). Only ``bounded_power`` caps a day's weight; ``lru`` and ``lfu`` are the classic scores.

    An entry's days are added from small to large, so entries with the same days have the same activity to the last digit.
    """
    days = daily(events, now)
    if kernel == "lru":
        value = 1 / (1 + F.min("age"))
    elif kernel == "lfu":
        value = F.sum("weight")
    else:
        weight = F.least(F.col("weight"), F.lit(daily_cap)) if kernel == "bounded_power" else F.col("weight")
        terms = F.collect_list(weight * S.decay(F.col("age"), kernel, half_life, exponent, window_days))  # one a day
        value = F.aggregate(F.array_sort(terms), F.lit(0.0), lambda s, x: s + x)
    return days.groupBy("entry_id").agg(value.alias("activity"))


def greedy_plan(entries: DataFrame, budget: int, group: list[str] | None = None) -> DataFrame:
    """(selected ids, units used, status): pinned entries first, then by activity x class per unit; what doesn't fit is skipped.

    ``entries`` has (id, pinned, resident_units, cost_class, activity) of current entries; a plan's group is sorted as one
    array, so it is meant for one store's entries.
    """
    group = group or []
    score = F.col("activity") * S.case_of(F.col("cost_class"), S.COST_MULTIPLIER, 1.25)
    key = F.struct((~F.col("pinned")).alias("free"), F.when(~F.col("pinned"), -F.round(score / F.col("resident_units"), 12)).otherwise(0.0).alias("order"), "id", F.col("resident_units").cast("long").alias("units"), score.alias("score"))
    listed = entries.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("es"))
    pinned = F.filter("es", lambda e: ~e["free"])
    required = F.aggregate(pinned, F.lit(0).cast("long"), lambda s, e: s + e["units"])
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc, e):
        take = (~e["free"]) | ((e["score"] > 0) & (acc["used"] + e["units"] <= budget))
        return F.when(take, F.struct((acc["used"] + e["units"]).alias("used"), F.concat(acc["ids"], F.array(e["id"])).alias("ids"))).otherwise(acc)

    p = listed.withColumn("required", required).withColumn("p", F.aggregate("es", zero, step))
    over = F.col("required") > budget
    return p.select(
        *group,
        F.when(over, "PINNED_OVER_BUDGET").otherwise("OK").alias("status"),
        F.when(over, F.array().cast("array<string>")).otherwise(F.col("p.ids")).alias("selected"),
        F.when(over, F.col("required")).otherwise(F.col("p.used")).alias("budget_used"),
    )


def audit(
    entries: DataFrame, scores: DataFrame, now: Column, last_hits: DataFrame, active: DataFrame,
    demote_below: float = 0.6, demote_after: int = 21, archive_below: float = 0.3, archive_after: int = 90,
) -> DataFrame:
    """Proposals for each entry: class, reason, review_due, and its places in the ranking and in the order of demotion.

    ``last_hits`` (id, last_hit) has the days of last use, ``active`` (store, source_hash) what the stores hold now. An entry that
    is not current, or of T0 with a source that its store no longer holds, is ``excluded``. Of T0, what scores low for its age is
    to ``demote``, or ``pinned_low_activity``; of T1, what scores low, is idle since its last use and not pinned, to ``archive``.
    T0 is ranked by activity to twelve digits, then by id; demotion goes from cheap to dear, then by activity.
    """
    held = active.select(F.col("store").alias("a_store"), F.col("source_hash").alias("a_hash"), F.lit(True).alias("held")).distinct()
    e = entries.join(scores, entries["id"] == scores["entry_id"], "left").join(last_hits.select(F.col("id").alias("hit_id"), "last_hit"), F.col("id") == F.col("hit_id"), "left")
    e = e.join(held, (F.col("store") == F.col("a_store")) & (F.col("source_hash") == F.col("a_hash")), "left").withColumn("activity", F.coalesce("activity", F.lit(0.0)))
    age, idle = F.datediff(now, F.col("created")), F.datediff(now, F.coalesce("last_hit", "created"))
    top = F.col("tier") == "T0"
    reason = F.when(~current(now), "status_or_validity").when(top & F.col("held").isNull(), "source_changed_or_removed")
    kind = (
        F.when(reason.isNotNull(), "excluded")
        .when(top & (F.col("activity") < demote_below) & (age > demote_after), F.when(F.col("pinned"), "pinned_low_activity").otherwise("demote"))
        .when((F.col("tier") == "T1") & (F.col("activity") < archive_below) & (idle > archive_after) & ~F.col("pinned"), "archive")
        .otherwise("keep")
    )
    due = reason.isNull() & F.coalesce(F.col("next_review") <= now, F.lit(False))
    out = e.select("id", "tier", "cost_class", kind.alias("class"), reason.alias("reason"), due.alias("review_due"), "activity", age.alias("age"), idle.alias("idle"))
    ranked = top & F.col("reason").isNull()
    # Sums of doubles depend on their order in the last digits, which must not decide between equal activities.
    scored = F.round("activity", 12)
    rank = F.row_number().over(Window.partitionBy(ranked).orderBy(F.desc(scored), "id"))
    demoted = F.col("class") == "demote"
    cost = F.array_position(F.array(F.lit("low"), F.lit("med"), F.lit("high")), F.col("cost_class"))
    nth = F.row_number().over(Window.partitionBy(demoted).orderBy(cost, scored, "id"))
    return out.withColumn("rank", F.when(ranked, rank)).withColumn("demote_rank", F.when(demoted, nth)).drop("cost_class")


def duplicate_pairs(texts: DataFrame, least: float = 0.55) -> DataFrame:
    """(store, id_a, id_b, ratio): pairs of one store whose texts match by difflib's ratio; ``texts`` is one audit's page."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    # A ratio above ``least`` needs lengths that allow it.
    l, r = (texts.select("store", F.col("id").alias(f"id_{s}"), F.substring("text", 1, 60).alias(f"t_{s}")) for s in "ab")
    near = l.join(r, "store").filter("id_a < id_b").filter(2 * F.least(F.length("t_a"), F.length("t_b")) > least * (F.length("t_a") + F.length("t_b")))
    return near.withColumn("ratio", ratio("t_a", "t_b")).filter(F.col("ratio") > least).drop("t_a", "t_b")


def directory(entries: DataFrame, last_events: DataFrame, now: Column) -> DataFrame:
    """Current T1 entries by (scope, locator): ids, count, latest day and its revision, whether pinned, highest class, topic and line.

    ``last_events`` (id, last_use) has each entry's latest event of any type. Entries whose locator is not safe have no line. Of
    entries equally late, the last by ``ordinal`` (else by id) gives the revision.
    """
    cost = F.array_position(F.array(F.lit("low"), F.lit("med"), F.lit("high")), F.coalesce("cost_class", F.lit("med")))
    e = entries.withColumn("where", S.entry_locator(F.col("locator"), F.col("store"))).filter((F.col("tier") == "T1") & current(now) & F.col("where").isNotNull())
    e = e.join(last_events, "id", "left").withColumn("day", F.greatest("created", "valid_from", "last_use"))
    order = F.col("ordinal") if "ordinal" in entries.columns else F.col("id")
    g = e.groupBy(S.entry_scope(F.col("scope")).alias("scope"), F.col("where").alias("locator")).agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"), F.max("day").alias("latest"), F.max_by(F.left(F.nullif("source_hash", F.lit("")), F.lit(12)), F.struct("day", order)).alias("revision"),
        F.bool_or("pinned").alias("pinned"), F.max(cost).cast("int").alias("cost"),
    )
    g = g.withColumn("revision", F.coalesce("revision", F.lit("-")))
    topic = S.locator_topic(F.col("locator"))
    line = F.concat_ws(" | ", topic, "scope", F.concat(F.col("n"), F.lit(" current")), F.date_format("latest", "yyyy-MM-dd"), F.concat(F.lit("rev:"), "revision"), "locator")
    return g.withColumn("topic", topic).withColumn("line", line).withColumn("units", F.octet_length("line") + 1)


def pack_directory(lines: DataFrame, budget: int) -> DataFrame:
    """``lines`` of ``directory`` with ``kept``: greedy by (pinned, cost, items, topic, locator); lines that don't fit are dropped."""
    key = F.struct((~F.col("pinned")).alias("a"), (-F.col("cost")).alias("b"), (-F.col("n")).alias("c"), "topic", "locator", "scope", F.col("units").cast("long").alias("units"))
    listed = lines.agg(F.array_sort(F.collect_list(key)).alias("ls"))  # a directory: one line per locator
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<scope:string,locator:string>>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["units"] <= budget, F.struct((a["used"] + x["units"]).alias("used"), F.concat(a["kept"], F.array(F.struct(x["scope"].alias("scope"), x["locator"].alias("locator")))).alias("kept"))).otherwise(a)
    kept = listed.select(F.explode(F.aggregate("ls", zero, step)["kept"]).alias("k")).select("k.scope", "k.locator", F.lit(True).alias("kept"))
    return lines.join(kept, ["scope", "locator"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def replay(uses: DataFrame, entries: DataFrame, budget: int, kernel: str = "bounded_power", half_life: float = 30.0) -> DataFrame:
    """(group, requests, hits, hit_rate): before each use of a group's chronology, would a greedy plan hold the entry?

    Uses are ordered by (t, event_id) within a group. A use fills its entry's day up to the cap, so a plan changes with the first use
    of an entry on a day and not again by that entry's later ones. Each day of a group is planned on its own, from the days on which
    its entries were used before: rows are one for each entry and day, however many uses there are. What a day's plans hold becomes
    spans of the chronology by entry, and uses are counted against the spans of their entry.
    """
    import math
    from bisect import bisect_left, insort

    def weight(age: float) -> float:
        if kernel == "legacy":
            return (age + 1) ** -0.5
        if kernel == "exponential":
            return 2 ** (-age / half_life)
        tau = half_life / 3
        return 0.0 if kernel == "bounded_power" and age > 180 else (1 + age / tau) ** -0.5

    def spans(firsts: list, history: list, day: int, es: list) -> dict[str, list]:
        """By entry: the spans (after, until) of a day's uses in which a plan holds it; None is an open end."""
        units = {e["id"]: (e["units"], e["mult"], e["pinned"]) for e in es}
        parts = {h["entry_id"]: [2.0 * weight(day - d) for d in h["days"] if d < day] for h in history}
        act = lambda i: math.fsum(parts.get(i, ()))
        row = lambda i: (not units[i][2], -act(i) * units[i][1] / units[i][0] if not units[i][2] else 0.0, i, units[i][0], act(i))
        order = sorted(r for r in map(row, units) if not r[0] or r[4] > 0)
        least = min((n for n, _, _ in units.values()), default=0)
        out: dict[str, list] = {}
        before: set[str] = set()
        for k in range(len(firsts) + 1):
            used, held = 0, set()
            for free, _, i, n, _ in order:
                if free and used + least > budget:
                    break
                if not free or used + n <= budget:
                    used += n
                    held.add(i)
            at = (firsts[k - 1]["event_id"], firsts[k - 1]["entry_id"]) if k else None
            for i in before - held:
                out[i][-1][1] = at
            for i in held - before:
                out.setdefault(i, []).append([at, None])
            before = held
            if k < len(firsts):
                i = firsts[k]["entry_id"]
                old = bisect_left(order, row(i))
                if old < len(order) and order[old][2] == i:
                    del order[old]
                parts.setdefault(i, []).append(2.0 * weight(0))
                if not units[i][2] or act(i) > 0:
                    insort(order, row(i))
        return out

    place = "struct<event_id:string,entry_id:string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = lambda x: x and {"event_id": x[0], "entry_id": x[1]}
        for pdf in batches:
            for group, day, firsts, history, es in zip(pdf["grp"], pdf["day"], pdf["firsts"], pdf["history"], pdf["es"], strict=True):
                found = spans(list(firsts), list(history), day, list(es))
                yield pd.DataFrame([(group, day, i, [{"after": named(a), "until": named(b)} for a, b in s]) for i, s in found.items()], columns=["grp", "day", "entry_id", "spans"])

    day = F.datediff("t", F.lit("1970-01-01").cast("date")).alias("day")
    each = uses.groupBy("grp", day, "event_id", "entry_id").agg(F.count("*").alias("n"))
    mult = S.case_of(F.col("cost_class"), S.COST_MULTIPLIER, 1.25).alias("mult")
    es = entries.agg(F.array_sort(F.collect_list(F.struct("id", F.col("resident_units").cast("long").alias("units"), mult, "pinned"))).alias("es"))
    known = uses.select("grp", day, "event_id", "entry_id").join(entries.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    firsts = known.groupBy("grp", "day", "entry_id").agg(F.min("event_id").alias("event_id"))
    days = uses.select("grp", day).distinct().join(firsts.groupBy("grp", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "entry_id"))).alias("firsts")), ["grp", "day"], "left")
    history = firsts.groupBy("grp", "entry_id").agg(F.array_sort(F.collect_list("day")).alias("days")).groupBy("grp").agg(F.collect_list(F.struct("entry_id", "days")).alias("history"))
    planned = days.join(history, "grp", "left").crossJoin(es)
    none = lambda c: F.coalesce(F.col(c), F.array().cast(planned.schema[c].dataType)).alias(c)
    planned = planned.select("grp", "day", none("firsts"), none("history"), "es").repartition("grp", "day")
    held = planned.mapInPandas(run, f"grp string, day int, entry_id string, spans array<struct<after:{place},until:{place}>>")
    at = F.struct("event_id", "entry_id")
    # A use sees the plan of the uses before it; a use that comes again sees itself.
    once = F.exists("spans", lambda s: F.coalesce(at > s["after"], F.lit(True)) & F.coalesce(at <= s["until"], F.lit(True)))
    again = F.exists("spans", lambda s: F.coalesce(at >= s["after"], F.lit(True)) & F.coalesce(at < s["until"], F.lit(True)))
    hit = F.coalesce(once.cast("long"), F.lit(0)) + (F.col("n") - 1) * F.coalesce(again.cast("long"), F.lit(0))
    total = each.join(held, ["grp", "day", "entry_id"], "left").groupBy("grp").agg(F.sum("n").alias("requests"), F.sum(hit).alias("hits"))
    return total.select("grp", "requests", "hits", (F.col("hits") / F.col("requests")).alias("hit_rate"))
