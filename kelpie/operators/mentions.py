"""Observations of anchors in messages, with the model's rules: sources that don't count, echoes, boundaries, exposure, places.

An alias is a literal text. It needs a word boundary only beside its own ASCII letters and digits, so CJK names and symbols are
found inside prose; it ignores case only where its anchor says so. An anchor is observed where enough of its aliases
stand within ``SPAN`` characters. All aliases of all anchors are found in one walk over a message by one machine for each way
of reading case; messages stay where they are, and only observations move. Nothing here raises an entry's activity: an observation
weighs nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Sources that don't count, the reach of a window, and limits of anchors.
DENIED = ["cron", "review", "test", "flush", "subagent", "background"]
SPAN, MAX_ANCHORS, MAX_ALIASES, MAX_ALIAS_CHARS = 200, 1000, 32, 256
#: Marks of the engine's own output, in lower case: what it has written itself is no observation.
ECHOES = ["[kelpie context]", "kelpie scan report", "memory audit report"]

MATCHES = "array<struct<anchor:string,start:int,end:int>>"


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def prepared(anchors: DataFrame) -> list[dict]:
    """A curated list of anchors (anchor, version, aliases, min_anchors, case_insensitive, valid_from, valid_until), checked."""
    rows, seen = [r.asDict() for r in anchors.limit(MAX_ANCHORS + 1).collect()], set()
    if len(rows) > MAX_ANCHORS:
        raise ValueError(f"at most {MAX_ANCHORS} anchors")
    for r in rows:
        if not (r["anchor"] or "").strip() or not (r["version"] or "").strip() or (r["anchor"], r["version"]) in seen:
            raise ValueError("an anchor needs a name and a version of its own")
        seen.add((r["anchor"], r["version"]))
        if not 1 <= len(r["aliases"] or []) <= MAX_ALIASES or any(a is None or a != a.strip() or not 2 <= len(a) <= MAX_ALIAS_CHARS for a in r["aliases"]):
            raise ValueError(f"an anchor has 1 to {MAX_ALIASES} trimmed aliases of 2 to {MAX_ALIAS_CHARS} characters")
        fold = bool(r.get("case_insensitive"))
        once: dict[str, str] = {}
        for a in r["aliases"]:
            once.setdefault(lowered(a) if fold else a, a)
        if not 1 <= (r["min_anchors"] or 1) <= len(once):
            raise ValueError("min_anchors must not exceed the distinct aliases")
        if r["valid_from"] and r["valid_until"] and r["valid_from"] >= r["valid_until"]:
            raise ValueError("invalid interval of an anchor")
        r |= {"fold": fold, "aliases": once, "min_anchors": r["min_anchors"] or 1}
    return rows


class Aliases:
    """The machines of all aliases: one that reads case and one that doesn't."""

    def __init__(self, anchors: list[dict]):
        import ahocorasick

        self.machines = {}
        for fold in (False, True):
            owners: dict[str, list[tuple[int, str]]] = {}
            for n, anchor in enumerate(anchors):
                if anchor["fold"] == fold:
                    for key, alias in anchor["aliases"].items():
                        owners.setdefault(key, []).append((n, alias))
            if owners:
                machine = ahocorasick.Automaton()
                for key, own in owners.items():
                    machine.add_word(key, (key, own))
                machine.make_automaton()
                self.machines[fold] = machine

    def places(self, text: str) -> dict[int, list[tuple[int, int, str]]]:
        """For each anchor found its (start, end, alias), in order; places of one alias don't overlap."""
        out: dict[int, list[tuple[int, int, str]]] = {}
        free: dict[tuple[int, str], int] = {}
        for fold, machine in self.machines.items():
            for last, (key, own) in machine.iter(lowered(text) if fold else text):
                end = last + 1
                start = end - len(key)
                if key[0].isascii() and key[0].isalnum() and start and re.match(r"\w", text[start - 1]) or key[-1].isascii() and key[-1].isalnum() and end < len(text) and re.match(r"\w", text[end]):
                    continue
                for n, alias in own:
                    if start >= free.get((n, alias), 0):
                        free[n, alias] = end
                        out.setdefault(n, []).append((start, end, alias))
        return {n: sorted(found) for n, found in out.items()}


def tight(places: list[tuple[int, int, str]], required: int) -> list[tuple[int, int, str]]:
    """The first place of each of ``required`` aliases in the first window of SPAN characters that has so many; else none."""
    window: list[tuple[int, int, str]] = []
    for place in places:
        if place[1] - place[0] > SPAN:
            continue
        window.append(place)
        while max(end for _, end, _ in window) - window[0][0] > SPAN:
            window.pop(0)
        first = {alias: (s, e, alias) for s, e, alias in reversed(window)}
        if len(first) >= required:
            return sorted(first.values(), key=window.index)[:required]
    return []


def reason(now: Column, days: int) -> Column:
    """Why a record (role, source, ts, text) isn't scanned; null if it is."""
    echo = F.lower(X.visible_text(F.col("text")))
    return (
        F.when((F.col("role") != "assistant") | F.col("role").isNull() | F.lower(F.coalesce("source", F.lit(""))).isin(*DENIED), "role_or_source")
        .when((F.col("ts") > now) | (F.col("ts") < now - F.make_dt_interval(F.lit(days))), "outside_window")
        .when(F.array_contains(F.transform(F.array(*map(F.lit, ECHOES)), lambda m: F.contains(echo, m)), True), "self_echo")
    )


def skipped(records: DataFrame, now: Column, days: int) -> DataFrame:
    """(reason, n): how many records were scanned, and why the others were not."""
    return records.groupBy(F.coalesce(reason(now, days), F.lit("scanned")).alias("reason")).agg(F.count("*").alias("n"))


def observed(records: DataFrame, anchors: DataFrame, scope: str, now: Column, days: int = 7) -> DataFrame:
    """Observations in records (id, session, role, source, ts, text, memory_versions) of the last ``days`` days.

    A text that is repeated at the same time, as branches of a session do, is one observation, of the smallest id. ``exposure`` tells whether
    the record had the anchor's version in memory; ``matches`` are places in the visible text, in code points from 0.
    """
    if not scope.strip() or not 1 <= days <= 90:
        raise ValueError("a scan has a scope and 1 to 90 days")
    known = prepared(anchors)
    scanned = records.filter(reason(now, days).isNull()).select(
        F.col("id").cast("string").alias("id"), F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), X.visible_text(F.col("text")).alias("visible"),
        F.sha2("text", 256).alias("source_text_hash"), F.to_json(F.coalesce("memory_versions", F.create_map().cast("map<string,string>"))).alias("versions"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Aliases(known)
        for batch in batches:
            at, rows = [], []
            for k, (text, versions) in enumerate(zip(batch.column("visible").to_pylist(), batch.column("versions").to_pylist(), strict=True)):
                for n, places in machine.places(text or "").items():
                    found = tight(places, known[n]["min_anchors"])
                    if found:
                        same = json.loads(versions).get(known[n]["anchor"]) == known[n]["version"]
                        at.append(k)
                        rows.append((known[n]["anchor"], known[n]["version"], "snapshot_matched" if same else "unknown", [{"anchor": a, "start": s, "end": e} for s, e, a in found]))
            anchor, version, exposure, matches = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("anchor", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            kept = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array(c, t) for c, t in zip((anchor, version, exposure, matches), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", "session", "ts", "visible", "source_text_hash")), *columns], names=["id", "session", "ts", "visible", "source_text_hash", "entry_id", "entry_version", "exposure", "matches"])

    found = scanned.mapInArrow(run, f"id string, session string, ts timestamp, visible string, source_text_hash string, entry_id string, entry_version string, exposure string, matches {MATCHES}")
    windows = anchors.select(F.col("anchor").alias("entry_id"), F.col("version").alias("entry_version"), "valid_from", "valid_until")
    valid = found.join(F.broadcast(windows), ["entry_id", "entry_version"])  # at most MAX_ANCHORS rows
    valid = valid.filter(F.coalesce(F.col("ts") >= F.col("valid_from"), F.lit(True)) & F.coalesce(F.col("ts") < F.col("valid_until"), F.lit(True)))
    named = valid.withColumn("event_id", F.sha2(F.concat_ws("\0", F.lit(scope), "entry_id", "entry_version", "visible", F.unix_micros("ts").cast("string")), 256))
    own = F.struct("id", "session", "ts", F.sha2("visible", 256).alias("text_hash"), "source_text_hash", "exposure", "matches", "entry_id", "entry_version")
    one = named.groupBy("event_id").agg(F.min(own).alias("o"))
    return one.select(
        "event_id", F.lit("mention_observed").alias("type"), F.lit(0.0).alias("weight"), F.lit(scope).alias("scope"), "o.entry_id", "o.entry_version", F.col("o.session").alias("session_id"), F.col("o.id").alias("message_id"),
        F.col("o.ts").alias("ts"), "o.text_hash", "o.source_text_hash", "o.matches", "o.exposure", F.lit("unverified").alias("usefulness"),
    )
