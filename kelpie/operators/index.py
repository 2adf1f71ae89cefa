"""The entry index: seeding, registration, feedback, reviews and migration, as frames in and frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

# Days until the next review after each confirmation.
REVIEW_DAYS = (3, 7, 30, 90)


def seeded(entries: DataFrame, texts: DataFrame, today: Column) -> DataFrame:
    """New entries for store texts (store, text) that no entry has, deleted ones included: a tombstone is never revived."""
    new = texts.select("store", "text", S.source_hash(F.col("store"), F.col("text")).alias("source_hash")).dropDuplicates(["source_hash"])
    new = new.join(entries.select("source_hash", "store"), ["source_hash", "store"], "left_anti")
    return new.select(
        F.concat(F.lit("e"), F.substring("source_hash", 1, 32)).alias("id"), F.lit("T0").alias("tier"), "store", F.left("text", F.lit(24)).alias("key"), F.left("text", F.lit(60)).alias("summary"),
        "source_hash", today.alias("created"), F.lit("med").alias("cost_class"), F.lit(False).alias("pinned"), F.lit("active").alias("status"), F.lit(0).alias("review_stage"),
        F.date_add(today, REVIEW_DAYS[0]).alias("next_review"),
    )


def found(entries: DataFrame, texts: DataFrame, needle: str) -> DataFrame:
    """The entry with this id, or else those whose key, summary or whole text holds the needle."""
    whole = texts.filter(F.contains("text", F.lit(needle))).select(S.source_hash(F.col("store"), F.col("text")).alias("source_hash")).distinct().withColumn("in_text", F.lit(True))
    e = entries.join(whole, "source_hash", "left")
    exact = F.col("id") == needle
    some = F.contains("key", F.lit(needle)) | F.contains("summary", F.lit(needle)) | F.coalesce("in_text", F.lit(False))
    hits = e.filter(exact | some).withColumn("exact", exact)
    best = hits.agg(F.max("exact").alias("best"))  # one row
    return hits.crossJoin(best).filter(F.col("exact") == F.col("best")).select(*entries.columns)


def only(rows: DataFrame) -> DataFrame:
    """``rows`` if there is exactly one, an error otherwise."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError("ENTRY_NOT_FOUND" if not n else "AMBIGUOUS_ENTRY")
    return rows


def fed_back(events: DataFrame, new: DataFrame, entries: DataFrame, texts: DataFrame, today: Column) -> DataFrame:
    """What becomes of each new event (entry_id, event_id, type, evidence): its outcome, and whether it is to be appended.

    A known event id is DUPLICATE; an entry must be current, in T0 and its text unchanged; one confirmation counts a day.
    """
    live = texts.select(S.source_hash(F.col("store"), F.col("text")).alias("source_hash")).distinct().withColumn("live", F.lit(True))
    e = entries.join(live, "source_hash", "left").select(F.col("id").alias("entry_id"), "status", "tier", F.coalesce("live", F.lit(False)).alias("live"))
    old = events.select("entry_id", "event_id", F.lit(True).alias("known"))
    confirmed = events.filter((F.col("type") == "confirm") & (F.col("t") == today)).select("entry_id").distinct().withColumn("done", F.lit(True))
    again = Window.partitionBy("entry_id", "type").orderBy("event_id")
    j = new.join(e, "entry_id", "left").join(old, ["entry_id", "event_id"], "left").join(confirmed, "entry_id", "left").withColumn("nth", F.row_number().over(again))
    confirm = F.col("type") == "confirm"
    outcome = (
        F.when(F.col("known"), "DUPLICATE").when(F.col("status").isNull(), "ENTRY_NOT_FOUND").when(F.col("status") != "active", "ENTRY_NOT_CURRENTLY_ELIGIBLE")
        .when(F.col("tier") != "T0", "NON_T0_FEEDBACK").when(~F.col("live"), "SOURCE_CHANGED_OR_REMOVED").when(confirm & (F.coalesce(F.trim("evidence"), F.lit("")) == ""), "CONFIRMATION_EVIDENCE_REQUIRED")
        .when(confirm & (F.coalesce("done", F.lit(False)) | (F.col("nth") > 1)), "ALREADY_CONFIRMED_TODAY").otherwise("OK")
    )
    return j.select("entry_id", "event_id", "type", outcome.alias("outcome"), (outcome == "OK").alias("append"), today.alias("t"))


def reviewed(entries: DataFrame, applied: DataFrame, today: Column) -> DataFrame:
    """``entries`` with the review stage and day of those that a confirmation moved on."""
    moved = applied.filter("append AND type = 'confirm'").select(F.col("entry_id").alias("id"), F.lit(1).alias("step")).distinct()
    stage = F.least(F.col("review_stage") + 1, F.lit(len(REVIEW_DAYS) - 1))
    j = entries.join(moved, "id", "left")
    due = F.date_add(today, F.element_at(F.array(*map(F.lit, REVIEW_DAYS)), stage + 1))
    return j.withColumns({"next_review": F.when(F.col("step") == 1, due).otherwise(F.col("next_review")), "review_stage": F.when(F.col("step") == 1, stage).otherwise(F.col("review_stage"))}).select(*entries.columns)


def pinned(entries: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """``entries`` with ``pinned`` set for the given ids."""
    j = entries.join(ids.select("id", F.lit(True).alias("named")).distinct(), "id", "left")
    return j.withColumn("pinned", F.when(F.col("named"), F.lit(value)).otherwise(F.col("pinned"))).select(*entries.columns)


def migrated(legacy: DataFrame, texts: DataFrame) -> DataFrame:
    """Version-1 entries (id, store, key, summary, cost_class, pinned) with hash and status: active if exactly one text fits.

    Old keys and summaries are the first 24 and 60 characters of a text whose lines are trimmed and joined by a space.
    """
    flat = F.array_join(F.filter(F.transform(F.split("text", r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), " ")
    t = texts.select("store", F.left(flat, F.lit(24)).alias("key"), F.left(flat, F.lit(60)).alias("summary"), S.source_hash(F.col("store"), F.col("text")).alias("h"))
    one = t.groupBy("store", "key", "summary").agg(F.count("*").alias("n"), F.first("h").alias("source_hash")).filter("n = 1").drop("n")
    j = legacy.join(one, ["store", "key", "summary"], "left")
    return j.withColumns({"status": F.when(F.col("source_hash").isNotNull(), "active").otherwise("unresolved_legacy"), "pinned": F.coalesce("pinned", F.col("cost_class") == "high")})


def receipt(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines to a new place; an existing one is never overwritten."""
    rows.write.mode("errorifexists").json(path)
