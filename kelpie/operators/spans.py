"""Packing that cuts a source into exact spans at blank lines and ends of sentences.

A text has at most ``MOST`` spans of at least ``LEAST`` characters that end at a boundary; the rest of a text belongs to the last one. A text
with fenced code has none, so code is packed whole or not at all. Spans, their order by the question's words and the packing
itself are SQL functions over a query's candidates; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The shortest span, the most spans of a text, and what ends one.
LEAST, MOST = 80, 4
BOUNDARY = r"\n\s*\n|[.!?。！？](?:\s+|$)"
#: A text in pieces, each up to and with its boundary; the last has none.
PIECES = rf"(?sdU)(?:.*?(?:{BOUNDARY})|.+$)"
SPAN = "struct<start:int,end:int>"


def spans(text: Column) -> Column:
    """(start, end) of a text's spans, in code points from 0, end exclusive."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), F.char_length)
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, n: Column) -> Column:
        at = acc["at"] + n
        cut = at - acc["start"] >= LEAST
        span = F.struct(acc["start"].alias("start"), at.alias("end"))
        return F.struct(F.when(cut, at).otherwise(acc["start"]).alias("start"), at.alias("at"), F.when(cut, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def ended(acc: Column) -> Column:
        n, whole = F.size(acc["spans"]), acc["at"]
        last = F.struct(F.get(acc["spans"], n - 1)["start"].alias("start"), whole.alias("end"))
        only = F.when(whole >= LEAST, F.array(F.struct(F.lit(0).alias("start"), whole.alias("end")))).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.when((acc["start"] >= whole) & (n > 0), acc["spans"]).when(n > 0, F.concat(F.slice(acc["spans"], 1, n - 1), F.array(last))).otherwise(only)

    return F.when(F.contains(text, F.lit("```")), F.array().cast(f"array<{SPAN}>")).otherwise(F.slice(F.aggregate(lengths, begin, step, ended), 1, MOST))


def label(rows: dict[str, Column], span: Column | None = None) -> Column:
    head = F.concat(F.lit('[source {"id": '), X.json_string(rows["id"]), F.lit(', "speaker": '), X.json_string(rows["speaker"]), F.lit(', "date": '), X.json_string(rows["timestamp"]))
    if span is not None:
        head = F.concat(head, F.lit(', "span": ['), span["start"].cast("string"), F.lit(", "), span["end"].cast("string"), F.lit('], "offsets": "unicode_codepoints"'))
    return F.concat(head, F.lit("}]\n"))


def pack(rows: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, n, complete, start, end, segment): rows (query_id, rank, id, speaker, timestamp, text) in rank order, whole or as one span.

    A block costs its UTF-8 bytes and two more for the blank line before all but the first. A row that doesn't fit gives the
    first span that does, by how many of the question's words it has and then by place; a span without any is not taken.
    """
    focus = questions.select("query_id", F.array_except(X.terms(F.col("query")), F.array(*map(F.lit, X.STOP))).alias("focus"))
    cols = {c: F.col(c) for c in ("id", "speaker", "timestamp")}
    part = lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"])
    scored = F.transform(
        spans(F.col("text")),
        lambda s: F.struct(
            (-F.size(F.array_intersect("focus", X.terms(part(s))))).alias("order"), s["start"].alias("start"), s["end"].alias("end"), (F.octet_length(label(cols, s)) + F.octet_length(part(s))).cast("long").alias("cost")
        ),
    )
    useful = F.array_sort(F.filter(scored, lambda s: (s["order"] < 0) & ~((s["start"] == 0) & (s["end"] == F.char_length("text")))))
    ready = rows.join(focus, "query_id").select(
        "query_id", F.struct("rank", F.col("id").cast("string").alias("id"), "text", (F.octet_length(label(cols)) + F.octet_length("text")).cast("long").alias("whole"), useful.alias("spans")).alias("r")
    )
    taken = "array<struct<id:string,n:int,complete:boolean,start:int,end:int,segment:string>>"
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(taken).alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        n = F.size(acc["taken"])
        room = F.lit(budget) - acc["used"] - F.when(n > 0, 2).otherwise(0)
        span = F.get(F.filter(r["spans"], lambda s: s["cost"] <= room), 0)
        whole = r["whole"] <= room
        start, end = F.when(whole, 0).otherwise(span["start"]), F.when(whole, F.char_length(r["text"])).otherwise(span["end"])
        one = F.struct(r["id"].alias("id"), n.alias("n"), whole.alias("complete"), start.alias("start"), end.alias("end"), F.substr(r["text"], start + 1, end - start).alias("segment"))
        used = F.lit(budget).cast("long") - room + F.when(whole, r["whole"]).otherwise(span["cost"])
        return F.when(whole | span.isNotNull(), F.struct(used.alias("used"), F.concat(acc["taken"], F.array(one)).cast(taken).alias("taken"))).otherwise(acc)

    listed = ready.groupBy("query_id").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)).alias("rs"))
    return listed.select("query_id", F.explode(F.aggregate("rs", begin, step, lambda acc: acc["taken"])).alias("t")).select("query_id", "t.*")
