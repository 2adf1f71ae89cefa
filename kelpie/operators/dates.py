"""Dates named in questions, and candidates whose source has that date.

A question names a year, a month or a day, in English or Chinese; relative days count only from an anchor that is given, never
from the clock. What can't be read for sure, an impossible date, or a comparison or a range, names nothing, and then the order
stays. All of it is column expressions over the questions.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names of months, and the words of the grammar.
MONTHS = [m.lower() for m in calendar.month_name[1:]]
SHORT = [m.lower() for m in calendar.month_abbr[1:]]
CHINESE = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]
RELATIVE = r"\b(?:yesterday|last week|two months ago)\b|昨天|上周|两个月前"
YESTERDAY, TWO_MONTHS = "yesterday|昨天", "two months ago|两个月前"
FIRST, LATEST = r"\b(?:first|earliest)\b|第一次|最早", r"\b(?:latest|last|previous)\b|最近|上一次"
COMPARED = r"\b(?:before|after|between|from|earlier|later)\b|之前|之后|以前|到|至|[–—]"
ISO = r"(?<!\d)([12]\d{3})[-年](\d{1,2})(?:[-月](\d{1,2}))?"

SIGNAL = "struct<year:int,month:int,day:int,order:string,relative_unresolved:boolean>"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def _signal(year: Column | None = None, month: Column | None = None, day: Column | None = None, order: Column | None = None, unresolved: bool = False) -> Column:
    none = F.lit(None).cast("int")
    parts = [none if c is None else c.cast("int") for c in (year, month, day)]
    return F.struct(*(c.alias(n) for c, n in zip(parts, ("year", "month", "day"), strict=True)), (F.lit("") if order is None else order).alias("order"), F.lit(unresolved).alias("relative_unresolved"))


def parsed(question: Column, anchor: Column | None = None) -> Column:
    """The date that a question names, as a struct of SIGNAL."""
    q = F.lower(question)
    anchor = F.lit(None).cast("date") if anchor is None else anchor.cast("date")
    ago = F.add_months(F.trunc(anchor, "month"), -2)
    relative = (
        F.when(anchor.isNull(), _signal(unresolved=True))
        .when(q.rlike(YESTERDAY), _signal(F.year(F.date_sub(anchor, 1)), F.month(F.date_sub(anchor, 1)), F.day(F.date_sub(anchor, 1))))
        .when(q.rlike(TWO_MONTHS), _signal(F.year(ago), F.month(ago)))
        .otherwise(_signal(unresolved=True))
    )
    order = F.when(q.rlike(LATEST), "latest").when(q.rlike(FIRST), "first").otherwise("")
    year = F.coalesce(_number(q, ISO, 1), _number(q, r"(?<!\d)([12]\d{3})(?!\d)", 1))
    # A month by name: full names in order of the year go before the short ones.
    month, day = F.lit(None).cast("int"), F.lit(None).cast("int")
    for number, name in reversed([*enumerate(MONTHS, 1), *enumerate(SHORT, 1)]):
        here = q.rlike(rf"\b{name}\b")
        month = F.when(here, number).otherwise(month)
        day = F.when(here, _number(q, rf"\b{name}\b(?:\s+(\d{{1,2}})(?!\d))?", 1)).otherwise(day)
    chinese = F.regexp_extract(q, r"(\d{1,2}|十一|十二|[一二三四五六七八九十])月", 1)
    table = F.create_map(*[x for n, c in enumerate(CHINESE, 1) for x in (F.lit(c), F.lit(n))])
    is_iso = q.rlike(ISO)
    month = F.when(is_iso, _number(q, ISO, 2)).otherwise(month)
    day = F.when(is_iso, _number(q, ISO, 3)).otherwise(day)
    month = F.when(chinese != "", F.coalesce(F.when(chinese.rlike(r"^\d"), chinese.cast("int")), F.element_at(table, chinese))).otherwise(month)
    dated = F.try_make_timestamp(F.coalesce(year, F.lit(2000)), month, F.coalesce(day, F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    wrong = (month.isNotNull() & dated.isNull()) | q.rlike(COMPARED)
    return F.when(q.rlike(RELATIVE), relative).when(wrong, _signal()).otherwise(_signal(year, month, day, order)).cast(SIGNAL)


def source_date(value: Column) -> Column:
    """The day of a source's time: ISO, or as in ``8 May, 2023``; null for anything else."""
    form = r"\b(\d{1,2}) ([A-Za-z]+), (\d{4})\b"
    name = F.lower(F.regexp_extract(value, form, 2))
    month = F.lit(None).cast("int")
    for number, (full, short) in enumerate(zip(MONTHS, SHORT, strict=True), 1):
        month = F.when(name.isin(full, short), number).otherwise(month)
    worded = F.to_date(F.try_make_timestamp(_number(value, form, 3), month, _number(value, form, 1), F.lit(0), F.lit(0), F.lit(0)))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2}:\d{2})"), F.to_date(F.try_to_timestamp(F.left(value, F.lit(10)), F.lit("yyyy-MM-dd"))))
    return F.coalesce(iso, worded)


def reorder(rows: DataFrame, questions: DataFrame, weight: float = 0.25) -> DataFrame:
    """(query_id, rowid, rank): rows (query_id, rowid, rank, timestamp) whose source has the date of the question move up.

    ``questions`` has (query_id, query) and may have ``anchor``, a date. The score is 1 / (60 + rank), plus ``weight`` / (60 + place among
    matching rows).
    """
    anchor = F.col("anchor") if "anchor" in questions.columns else None
    q = questions.select("query_id", parsed(F.col("query"), anchor).alias("s"))
    day = source_date(F.col("timestamp"))
    fits = [F.col(f"s.{n}").isNull() | (F.col(f"s.{n}") == f(F.col("__day"))) for n, f in (("year", F.year), ("month", F.month), ("day", F.day))]
    named = ~F.col("s.relative_unresolved") & F.coalesce("s.year", "s.month", "s.day").isNotNull()
    marked = rows.select("query_id", "rowid", "rank", day.alias("__day")).join(q, "query_id")
    marked = marked.withColumn("__hit", F.coalesce(named & F.col("__day").isNotNull() & fits[0] & fits[1] & fits[2], F.lit(False)))
    by_query = Window.partitionBy("query_id").orderBy("rank")
    placed = marked.withColumn("n", F.row_number().over(by_query)).withColumn("place", F.count_if("__hit").over(by_query))
    score = 1 / (60 + F.col("n")) + F.when(F.col("__hit"), F.lit(weight) / (60 + F.col("place"))).otherwise(0.0)
    return placed.select("query_id", "rowid", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "n")).alias("rank"))
