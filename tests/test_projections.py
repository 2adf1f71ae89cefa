"""Dates in questions and spans of texts, against hand-made answers and plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kelpie.functions import text as X
from kelpie.operators import dates, spans


@pytest.mark.parametrize(
    ("question", "anchor", "want"),
    [
        ("2026-05", None, (2026, 5, None, "", False)), ("2026年5月", None, (2026, 5, None, "", False)), ("May 2026", None, (2026, 5, None, "", False)), ("五月", None, (None, 5, None, "", False)), ("May 3", None, (None, 5, 3, "", False)),
        ("yesterday", None, (None, None, None, "", True)), ("昨天", "2024-03-01", (2024, 2, 29, "", False)), ("two months ago", "2024-01-31", (2023, 11, None, "", False)), ("上周", "2024-03-01", (None, None, None, "", True)),
        ("2025-02-29", None, (None,) * 3 + ("", False)), ("before 2025", None, (None,) * 3 + ("", False)), ("the latest of 2025", None, (2025, None, None, "latest", False)), ("第一次", None, (None, None, None, "first", False)),
        ("2026-05-07 notes", None, (2026, 5, 7, "", False)), ("十二月", None, (None, 12, None, "", False)), ("12月 2025", None, (2025, 12, None, "", False)), ("sept 31", None, (None,) * 3 + ("", False)), ("maybe 99999", None, (None,) * 3 + ("", False)),
        ("sep 31", None, (None,) * 3 + ("", False)), ("first and last", None, (None, None, None, "latest", False)), ("", None, (None,) * 3 + ("", False)), ("2024–2025", None, (None,) * 3 + ("", False)),
    ],
)
def test_parsed_dates(spark, question, anchor, want):
    df = spark.createDataFrame([(question, anchor)], "q string, a string")
    assert tuple(df.select(dates.parsed(F.col("q"), F.col("a").cast("date")).alias("s")).first().s) == want


def test_source_dates_and_an_order_without_a_date(spark):
    values = ["1:56 pm on 8 May, 2023", "2023-05-08", "2023-05-08T10:00:00Z", "2023-05-08 10:00", "invalid", "", None, "31 Feb, 2023", "2023-13-01", "8 Maybe, 2023"]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(dates.source_date(F.col("v")).cast("string")).collect()]
    assert got == ["2023-05-08"] * 4 + [None] * 6
    rows = spark.createDataFrame([(1, k, k, "2023-05-0" + str(k)) for k in range(1, 6)] + [(2, 9, 1, "2023-05-01"), (2, 8, 2, "x")], "query_id bigint, rowid bigint, rank int, timestamp string")
    asked = spark.createDataFrame([(1, "on 2023-05-04"), (2, "storage settings")], "query_id bigint, query string")
    got = sorted((r.query_id, r["rank"], r.rowid) for r in dates.reorder(rows, asked).collect())
    assert [r[2] for r in got if r[0] == 1] == [4, 1, 2, 3, 5] and [r[2] for r in got if r[0] == 2] == [9, 8]


def plain_spans(text):
    if "```" in text:
        return []
    ends = [m.end() for m in re.finditer(spans.BOUNDARY, text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    out, start = [], 0
    for end in ends:
        if end - start >= spans.LEAST:
            out.append([start, end])
            start = end
    if start < len(text):
        if out:
            out[-1][1] = len(text)
        elif len(text) >= spans.LEAST:
            out.append([0, len(text)])
    return [tuple(x) for x in out[: spans.MOST]]


def texts():
    rng = random.Random(12)
    bits = ["Storage ", "x" * 30, "one two. ", "。", "你好世界。", "\n\n", "\n \n", "!\n", "end.", "? ", "🙂", "```", "word ", ".no", "\r\n\r\n"]
    return ["", "tiny", ("你好世界。" * 20 + "\n\n") * 8, "```\ncode\n```" + "x" * 200, "y" * 79, "y" * 80, "z" * 90 + ".", "a" * 100 + "\n\n" + "b" * 10] + ["".join(rng.choice(bits[: 11 + k % 4]) for _ in range(rng.randrange(60))) for k in range(150)]


def test_spans_equal_a_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "k int, t string")
    for r in df.select("k", "t", spans.spans(F.col("t")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == plain_spans(r.t), r.t


def plain_pack(rows, focus, budget):
    used, out = 0, []
    for i, text in rows:
        room = budget - used - (2 if out else 0)
        head = f'[source {{"id": "{i}", "speaker": "s", "date": "d"'
        whole = len((head + "}]\n" + text).encode())
        found = None
        if whole <= room:
            found = (whole, True, 0, len(text))
        else:
            ranked = sorted((-len(focus & X.terms_of(text[a:b])), a, b) for a, b in plain_spans(text))
            for n, a, b in ranked:
                cost = len((head + f', "span": [{a}, {b}], "offsets": "unicode_codepoints"}}]\n' + text[a:b]).encode())
                if n and (a, b) != (0, len(text)) and cost <= room:
                    found = (cost, False, a, b)
                    break
        if found:
            used += found[0] + (2 if out else 0)
            out.append((i, len(out), *found[1:], text[found[2] : found[3]]))
    return out


@pytest.mark.parametrize("budget", [0, 128, 350, 900])
def test_packing_by_spans(spark, budget):
    every = [(q, k, f"r{q}-{k}", "s", "d", t) for q in range(12) for k, t in enumerate(texts()[q * 12 : q * 12 + 12])]
    rows = spark.createDataFrame(every, "query_id bigint, rank int, id string, speaker string, timestamp string, text string")
    asked = spark.createDataFrame([(q, "the Storage of one 世界") for q in range(12)], "query_id bigint, query string")
    got = {}
    for r in spans.pack(rows, asked, budget).collect():
        got.setdefault(r.query_id, []).append((r.id, r.n, r.complete, r.start, r.end, r.segment))
    for q in range(12):
        want = plain_pack([(i, t) for x, _, i, _, _, t in every if x == q], {"storage", "one", "世界"}, budget)
        assert sorted(got.get(q, []), key=lambda r: r[1]) == want
