"""Zero-weight observations: which anchors the messages of a window mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def windowed(records: DataFrame, now: Column, days: int) -> DataFrame:
    """Assistant messages of the last ``days`` days up to ``now`` (columns ts, role)."""
    return records.filter((F.col("role") == "assistant") & (F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(F.lit(days))))


def skipped(records: DataFrame, now: Column, days: int) -> DataFrame:
    """(reason, n): why records were not scanned."""
    reason = F.when(F.col("role") != "assistant", "role").when(F.col("ts") > now, "future").when(F.col("ts") < now - F.make_dt_interval(F.lit(days)), "too_old").otherwise("scanned")
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def scan(records: DataFrame, anchors: DataFrame, span: int = 200) -> DataFrame:
    """(event_id, anchor, version, id, session, day, n_aliases): records whose visible text holds enough aliases close together.

    Anchors are a curated list; each alias meets only records that hold its first word. ``min_anchors`` distinct aliases must
    stand within ``span`` characters, wherever in the text; every whole-word place of an alias counts. Copies of a text at the same time collapse to one event.
    """
    r = records.withColumn("visible", X.visible_text(F.col("text")))
    words = r.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("visible"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("head"))
    a = anchors.select("anchor", "version", "min_anchors", "valid_from", "valid_until", F.explode("aliases").alias("alias")).withColumn("head", F.lower(F.regexp_extract("alias", r"(?U)\w+", 0)))
    hits = words.join(a, "head").select("id", "anchor", "version", "min_anchors", "valid_from", "valid_until", "alias").join(r, "id")
    hits = hits.filter(F.coalesce(F.col("ts") >= F.col("valid_from"), F.lit(True)) & F.coalesce(F.col("ts") < F.col("valid_until"), F.lit(True)))
    at = hits.withColumn("place", F.explode(X.word_places(F.col("visible"), F.col("alias")))).select("*", "place.start", "place.end").drop("place")
    w = Window.partitionBy("id", "anchor", "version").orderBy("start").rangeBetween(0, span)
    near = at.withColumn("close", F.size(F.array_distinct(F.transform(F.filter(F.collect_list(F.struct("alias", "end")).over(w), lambda x: x["end"] <= F.col("start") + span), lambda x: x["alias"]))))
    enough = near.groupBy("id", "anchor", "version", "min_anchors").agg(F.max("close").alias("n_aliases"), F.first("visible").alias("visible"), F.first("session").alias("session"), F.first("ts").alias("ts"))
    found = enough.filter("n_aliases >= min_anchors").withColumn(
        "event_id", F.sha2(F.concat_ws("\0", "anchor", "version", "visible", F.col("ts").cast("string")), 256)
    )
    first = Window.partitionBy("event_id").orderBy("id")
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").select("event_id", "anchor", "version", "id", "session", F.to_date("ts").alias("day"), "n_aliases")


def summary(observations: DataFrame) -> DataFrame:
    """Mentions, sessions and days of each anchor; two sessions on two days make a review candidate."""
    s = observations.groupBy("anchor", "version").agg(F.count("*").alias("mentions"), F.count_distinct("session").alias("sessions"), F.count_distinct("day").alias("days"))
    return s.withColumn("review_candidate", (F.col("sessions") >= 2) & (F.col("days") >= 2))


def new_only(observations: DataFrame, stored: DataFrame) -> DataFrame:
    return observations.join(stored.select("event_id"), "event_id", "left_anti")
