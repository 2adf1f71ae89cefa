"""The driver's tables seen as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# How event types of the driver's table stand for kinds of telemetry.
KIND_OF = {"view": "planned_retrieval", "click": "resident_hit", "purchase": "resident_miss", "error": "hard_miss", "signup": "prefetch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as documents of one scope; ``rowid`` is unique and in (session, ord) order."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("rowid"),
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.lit("conv").alias("scope"),
        F.col("conv_id").cast("string").alias("session"),
        F.col("turn").alias("ord"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("role").alias("speaker"),
        F.lit("").alias("timestamp"),
        F.concat(F.lit("conversation:"), F.col("conv_id")).alias("source"),
        F.lit("T1").alias("tier"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus documents: a scope for each language, a session for each source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("rowid"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("scope"),
        F.col("source").alias("session"),
        F.col("doc_id").alias("ord"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").alias("speaker"),
        F.lit("").alias("timestamp"),
        F.col("source").alias("source"),
        F.lit("T1").alias("tier"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: each asks for the documents that hold it."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("passage"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry rows with the full telemetry schema."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    tokens = F.round("value").cast("long")
    prefetch = F.col("kind") == "prefetch"
    return (
        e.withColumn("kind", F.element_at(kinds, F.col("event_type")))
        .select(
            F.col("event_id").cast("string").alias("event_id"),
            F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("task_id"),
            "kind",
            F.concat(F.lit("item"), F.get_json_object("props", "$.k")).alias("item_id"),
            tokens.alias("extra_tokens"),
            F.lit(1).cast("long").alias("extra_tool_calls"),
            F.col("value").alias("extra_latency_ms"),
            (F.col("value") / 1000).alias("extra_cost_usd"),
            (F.col("event_id") % 2 == 0).alias("avoidable"),
            F.when(prefetch, F.col("event_id") % 3 == 0).alias("used"),
            F.when(prefetch & (F.col("event_id") % 5 != 0), F.col("event_id") % 7 == 0).alias("avoided_miss"),
            F.when(prefetch, F.when(F.col("event_id") % 7 == 0, tokens * 2).otherwise(0)).alias("avoided_extra_tokens"),
            F.col("ts"),
        )
    )


def use_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated activity of entries: a row per event with type and day."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "hit").when(F.col("event_type") == "signup", "confirm").when(F.col("event_type") == "view", "display").otherwise("create")
    return e.select(
        F.concat(F.lit("item"), F.get_json_object("props", "$.k")).alias("entry_id"), F.col("event_id").cast("string").alias("event_id"), kind.alias("type"), F.to_date("ts").alias("t")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries: one for each item of the events, its class, units, state, validity and source by rule from its number."""
    k = F.get_json_object("props", "$.k").cast("long")
    items = table(spark, sf_dir, "events").select(k.alias("k")).distinct()
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("k") % n + 1).cast("int"))
    store = F.when(F.col("k") % 2 == 0, "MEMORY.md").otherwise("USER.md")
    source = scalars.source_hash(store, F.concat(F.lit("text "), "k"))
    return items.select(
        F.concat(F.lit("item"), "k").alias("id"),
        F.when(F.col("k") % 4 == 0, "T0").otherwise("T1").alias("tier"),
        F.when(F.col("k") % 29 == 9, "../outside.md")
        .when(F.col("k") % 31 == 7, "/etc/absolute.md")
        .otherwise(F.concat(F.lit("warm/"), (F.col("k") % 10).cast("string"), F.lit("/topic_"), (F.col("k") % 25).cast("string"), F.lit(".md")))
        .alias("locator"),
        F.concat(F.lit("scope"), (F.col("k") % 2).cast("string")).alias("scope"),
        pick(3, "low", "med", "high").alias("cost_class"),
        (F.col("k") % 23 == 0).alias("pinned"),
        F.when(F.col("k") % 17 == 5, "invalid").otherwise("active").alias("status"),
        (5 + F.col("k") % 13).alias("resident_units"),
        F.when(F.col("k") % 3 == 0, (F.col("k") % 50).cast("double")).alias("miss_penalty_tokens"),
        F.date_add(F.lit("2023-10-01").cast("date"), (F.col("k") % 60).cast("int")).alias("created"),
        F.when(F.col("k") % 11 == 3, F.lit("2024-06-01").cast("date")).when(F.col("k") % 11 == 4, F.lit("2023-12-24").cast("date")).alias("valid_from"),
        F.when(F.col("k") % 13 == 4, F.lit("2024-01-15").cast("date")).alias("valid_until"),
        F.when(F.col("k") % 7 == 2, F.lit("2024-02-01").cast("date")).when(F.col("k") % 7 == 3, F.lit("2024-12-01").cast("date")).alias("next_review"),
        store.alias("store"),
        source.alias("source_hash"),
    )


def active_sources(entries: DataFrame) -> DataFrame:
    """(store, source_hash) of the texts that the stores still hold: those of most entries."""
    return entries.filter(F.substring("source_hash", 1, 1) != "0").select("store", "source_hash")
