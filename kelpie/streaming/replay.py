"""Uses released in order of their time from shuffled and repeated deliveries, each scored before it is observed.

A use is held until the watermark has passed its time; then no earlier one can still come, and the uses of an entry leave in
order of (time, id). A timer at the time of the earliest held use wakes an entry up, so entries without new rows release
theirs too. A repeated delivery of a held use replaces itself; one of a released use is behind the watermark, where Spark drops
it. What is kept for an entry are its held uses and the number of its uses on each day of the activity window, however long
its history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S

OUT = "entry_id string, event_id string, ts timestamp, ordinal bigint, activity_before double"


def decay(age: int, half_life: float = 30.0, exponent: float = 0.5) -> float:
    """The power kernel of ``scalars.kernel`` for one age."""
    return (1 + age / (half_life / (2 ** (1 / exponent) - 1))) ** -exponent


class Replay(StatefulProcessor):
    def __init__(self, window_days: int, daily_cap: float):
        self.window_days, self.daily_cap = window_days, daily_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ts array<bigint>, ids array<string>, alarm bigint")
        self.seen = handle.getValueState("seen", "n bigint, days array<int>, uses array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts, ids, alarm = self.held.get() if self.held.exists() else ([], [], None)
        held = dict(zip(ids, ts, strict=True))
        for pdf in rows:
            held |= dict(zip(pdf["event_id"], pdf["us"].astype("int64").tolist(), strict=True))
        self._hold(held, alarm)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, ids, _ = self.held.get()
        due = timerValues.getCurrentWatermarkInMs() * 1000
        held = dict(zip(ids, ts, strict=True))
        n, days, uses = self.seen.get() if self.seen.exists() else (0, [], [])
        counts, out = dict(zip(days, uses, strict=True)), []
        for at, event in sorted((t, i) for i, t in held.items() if t <= due):
            day = at // 86_400_000_000
            counts = {d: c for d, c in counts.items() if day - d <= self.window_days}
            score = sum(min(S.WEIGHTS["hit"] * c, self.daily_cap) * decay(day - d) for d, c in sorted(counts.items()))
            out.append((key[0], event, pd.Timestamp(at, unit="us"), n, score))
            counts[day] = counts.get(day, 0) + 1
            n += 1
            del held[event]
        self.seen.update((n, list(counts), list(counts.values())))
        self._hold(held, None)
        yield pd.DataFrame(out, columns=["entry_id", "event_id", "ts", "ordinal", "activity_before"])

    def _hold(self, held: dict[str, int], alarm: int | None) -> None:
        first = -(-min(held.values()) // 1000) if held else None
        if first is not None and (alarm is None or first < alarm):
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(first)
            alarm = first
        self.held.update((list(held.values()), list(held), alarm))

    def close(self) -> None:
        pass


def replayed(uses: DataFrame, delay: str, window_days: int = 180, daily_cap: float = 2.0) -> DataFrame:
    """A stream of (entry_id, event_id, ts, ordinal, activity_before) from one of (entry_id, event_id, ts); needs the RocksDB state store.

    ``delay`` is how far behind the newest time a delivery may come; ``ordinal`` counts the entry's earlier uses, ``activity_before`` is
    its bounded activity without this one.
    """
    rows = uses.withWatermark("ts", delay).select("entry_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("entry_id").transformWithStateInPandas(Replay(window_days, daily_cap), OUT, "Append", "EventTime")


def replayed_batch(uses: DataFrame, window_days: int = 180, daily_cap: float = 2.0) -> DataFrame:
    """What ``replayed`` gives for all of ``uses``, as one batch: days of an entry meet its earlier days."""
    from pyspark.sql.window import Window

    one = uses.dropDuplicates(["entry_id", "event_id"]).withColumn("day", F.unix_date(F.to_date("ts")))
    by_entry = Window.partitionBy("entry_id").orderBy("ts", "event_id")
    ranked = one.withColumn("ordinal", F.row_number().over(by_entry) - 1).withColumn("today", F.row_number().over(Window.partitionBy("entry_id", "day").orderBy("ts", "event_id")) - 1)
    days = one.groupBy("entry_id", "day").agg(F.count("*").alias("n"))
    earlier = days.select("entry_id", F.col("day").alias("before"), "n")
    pairs = days.select("entry_id", "day").join(earlier, "entry_id").filter((F.col("before") < F.col("day")) & (F.col("day") - F.col("before") <= window_days))
    weight = lambda n: F.least(F.lit(S.WEIGHTS["hit"]) * n, F.lit(daily_cap))
    kept = S.decay(F.col("day") - F.col("before"), "bounded_power", window_days=window_days)
    past = pairs.groupBy("entry_id", "day").agg(F.sum(weight(F.col("n")) * kept).alias("past"))
    both = ranked.join(past, ["entry_id", "day"], "left")
    return both.select("entry_id", "event_id", "ts", F.col("ordinal").cast("long").alias("ordinal"), (F.coalesce("past", F.lit(0.0)) + weight(F.col("today"))).alias("activity_before"))
