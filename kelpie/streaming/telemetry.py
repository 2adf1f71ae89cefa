"""Continuous forms of the telemetry roll-up; an extension, the model itself is a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.telemetry import DEMAND, MISS


def deduplicated(events: DataFrame, delay: str = "90 days") -> DataFrame:
    """Repeated deliveries of an event id within the watermark are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def rolling(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and penalties by item and event-time window."""
    e = events.withWatermark("ts", delay)
    demand, miss = F.col("kind").isin(*DEMAND), F.col("kind").isin(*MISS)
    return e.groupBy(F.window("ts", window).alias("w"), "item_id").agg(
        F.count_if(demand).alias("needs"), F.count_if(miss).alias("misses"), F.sum(F.when(miss, F.col("extra_tokens")).otherwise(0)).alias("miss_extra_tokens")
    ).select("item_id", F.col("w.start").alias("from_ts"), "needs", "misses", "miss_extra_tokens")


def last_use_gaps(events: DataFrame) -> DataFrame:
    """(item_id, uses, longest_gap_s): running use count and longest gap between uses, kept as state per item."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        uses, last, gap = state.get if state.exists else (0, None, 0.0)
        for pdf in batches:
            for at in sorted(pdf["ts"].astype("int64") / 1e9 if pdf["ts"].dtype.kind != "M" else pdf["ts"].map(pd.Timestamp.timestamp)):
                gap = max(gap, at - last) if last is not None else gap
                uses, last = uses + 1, at if last is None else max(last, at)
        state.update((uses, last, gap))
        yield pd.DataFrame([(key[0], uses, gap)], columns=["item_id", "uses", "longest_gap_s"])

    return events.select("item_id", "ts").groupBy("item_id").applyInPandasWithState(
        run, "item_id string, uses bigint, longest_gap_s double", "uses bigint, last double, gap double", "update", "NoTimeout"
    )
