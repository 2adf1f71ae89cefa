"""Queries of the projections that reorder or cut candidates: names, dates and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dates, entities, ranking, spans
from ..sources import driver as D
from .retrieval import TERM, TURNS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_W = r"[\p{L}\p{N}_"
BEFORE = rf"NOT regexp_matches(CHAR, '{_W}./\\:@#%&=~+?-]')"
AFTER = rf"NOT regexp_matches(CHAR, '^({_W}/\\:@#%&=~+-]|[.?]{_W}/])')"
NAMES = r"""names AS (SELECT DISTINCT unnest([regexp_extract(text, '^\S+\s+\S+'), regexp_extract(text, '^\S+\s+\S+\s+\S+')]) AS name FROM benchmark)"""


@query(f"""WITH {NAMES}, hits AS (SELECT doc_id, text, name, string_split(text, name) AS p FROM documents JOIN names ON name <> '' AND contains(text, name)),
    starts AS (SELECT doc_id, text, name, unnest(list_transform(range(1, len(p)), lambda i: (list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(name))::INTEGER)) AS s FROM hits),
    longest AS (SELECT doc_id, s, any_value(text) AS text, arg_max(name, length(name)) AS name FROM starts GROUP BY ALL),
    whole AS (SELECT doc_id, name, s, s + length(name) AS e FROM longest WHERE (s = 0 OR {BEFORE.replace('CHAR', 'substr(text, s, 1)')}) AND {AFTER.replace('CHAR', 'substr(text, s + length(name)::INTEGER + 1, 2)')})
    SELECT doc_id AS rowid, name, s::INTEGER AS start, e::INTEGER AS "end" FROM whole QUALIFY s >= coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0)""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the first two and the first three words of every benchmark passage as names in all documents."""
    start = [F.regexp_extract("text", rf"^\S+\s+\S+{more}", 0) for more in ("", r"\s+\S+")]
    names = D.table(spark, sf_dir, "benchmark").select(F.explode(F.array(*start)).alias("name"))
    return entities.mentions(D.table(spark, sf_dir, "documents"), names, id_col="doc_id")


@query(rf"""WITH {TURNS}, words AS (SELECT session, ord, unnest(regexp_extract_all(text, '[a-zà-ÿ]{{5,}}')) AS w FROM turns),
    picked AS (SELECT session, min({{'n': -length(w), 'w': w}}).w AS w FROM words JOIN (SELECT session, max(ord) AS ord FROM turns GROUP BY ALL) USING (session, ord) GROUP BY ALL),
    q AS (SELECT session, CASE WHEN session::INTEGER % 2 = 0 THEN 'user' ELSE 'nobody' END AS who, w, row_number() OVER () AS n FROM picked),
    hit AS (SELECT t.session, rowid, ord + 1 AS rank, speaker = who OR regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_./\\:@#%&=~+?-])' || w || '($|[^\p{{L}}\p{{N}}_./?\\:@#%&=~+-]|[.?]($|[^\p{{L}}\p{{N}}_/]))') AS hit FROM turns t JOIN q USING (session)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rank) AS n, CASE WHEN hit THEN row_number() OVER (PARTITION BY session, hit ORDER BY rank) END AS place FROM hit)
    SELECT session::BIGINT AS query_id, rowid, (row_number() OVER (PARTITION BY session ORDER BY 1.0 / (60 + n) + coalesce(0.25 / (60 + place), 0) DESC, n))::INTEGER AS rank FROM placed""")
def entity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's turns for a question that quotes the longest word of its last turn and, in every second one, names a speaker."""
    t = D.turns(spark, sf_dir)
    last = t.groupBy("session").agg(F.max_by("text", "ord").alias("text"))
    words = F.regexp_extract_all("text", F.lit("[a-zà-ÿ]{5,}"), F.lit(0))
    word = F.array_min(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))["w"]
    who = F.when(F.col("session").cast("int") % 2 == 0, "user").otherwise("nobody")
    q = last.select(F.col("session").cast("long").alias("query_id"), F.concat(F.lit("what did "), who, F.lit(" say about `"), word, F.lit("`?")).alias("query")).filter("query IS NOT NULL")
    rows = t.withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord") + 1)
    return ranking.entity_reorder(rows, q)


# Questions, an anchor, and the year, month and day that a reader finds in each.
ASKED = [
    ("what was said in 2024-05", None, 2024, 5, None), ("2024年7月 我们说了什么", None, 2024, 7, None), ("notes of May 2024", None, 2024, 5, None), ("五月", None, None, 5, None), ("Feb 3 please", None, None, 2, 3),
    ("yesterday", None, None, None, None), ("昨天", "2024-03-01", 2024, 2, 29), ("two months ago", "2024-08-31", 2024, 6, None), ("2024-02-30", None, None, None, None), ("before 2024", None, None, None, None),
    ("the first in 2023", None, 2023, None, None), ("十一月 2024", None, 2024, 11, None), ("storage settings", None, None, None, None), ("last week", "2024-03-01", None, None, None), ("2024-10-09", None, 2024, 10, 9),
]


def _number(x) -> str:
    return "NULL" if x is None else str(x)


ANSWERS = ", ".join(f"({k}, {_number(y)}, {_number(m)}, {_number(d)})" for k, (_, _, y, m, d) in enumerate(ASKED))


@query(f"""WITH {TURNS}, asked(k, y, m, d) AS (VALUES {ANSWERS}),
    dated AS (SELECT session::BIGINT AS query_id, rowid, ord + 1 AS rank, CASE WHEN ord % 5 = 4 THEN NULL ELSE DATE '2024-01-01' + ((session::INTEGER * 7 + ord * 11) % 340)::INTEGER END AS day FROM turns),
    hits AS (SELECT query_id, rowid, rank, coalesce(coalesce(y, m, d) IS NOT NULL AND day IS NOT NULL AND coalesce(y = year(day), true) AND coalesce(m = month(day), true) AND coalesce(d = day(day), true), false) AS hit
             FROM dated JOIN asked ON k = query_id % {len(ASKED)}),
    placed AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (hit) OVER w AS place FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY rank))
    SELECT query_id, rowid, (row_number() OVER (PARTITION BY query_id ORDER BY 1.0 / (60 + n) + CASE WHEN hit THEN 0.25 / (60 + place) ELSE 0 END DESC, n))::INTEGER AS rank FROM placed""")
def date_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's turns for one of fifteen questions with a date; turns have an ISO time, a worded one, or one that tells nothing."""
    t = D.turns(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("session").cast("int") * 7 + F.col("ord") * 11) % 340).cast("int"))
    worded = F.concat(F.lit("1:56 pm on "), F.date_format(day, "d MMMM, yyyy"))
    time = F.when(F.col("ord") % 5 == 4, "some day").when(F.col("ord") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(worded)
    rows = t.withColumn("timestamp", time).withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord") + 1)
    forms = F.array(*(F.struct(F.lit(q).alias("query"), F.lit(a).cast("date").alias("anchor")) for q, a, *_ in ASKED))
    q = rows.select("query_id").distinct().withColumn("f", F.element_at(forms, (F.col("query_id") % len(ASKED) + 1).cast("int")))
    return dates.reorder(rows, q.select("query_id", "f.query", "f.anchor"))


HEAD = """'[source {"id": "' || id || '", "speaker": "' || speaker || '", "date": "' || "timestamp" || '"'"""


@query(rf"""WITH {TURNS}, pieces AS (SELECT *, regexp_extract_all(text, '(?s).*?(
\s*
|[.!?。！？](\s+|$))|(?s).+$') AS p FROM turns),
    cut AS (SELECT * EXCLUDE p, length(text) AS n, list_reduce(list_transform(p, lambda x: {{'a': 0::BIGINT, 'b': length(x), 's': []::STRUCT(a BIGINT, b BIGINT)[]}}), lambda acc, x:
        CASE WHEN acc.b + x.b - acc.a >= {spans.LEAST} THEN {{'a': acc.b + x.b, 'b': acc.b + x.b, 's': acc.s || [{{'a': acc.a, 'b': acc.b + x.b}}]}} ELSE {{'a': acc.a, 'b': acc.b + x.b, 's': acc.s}} END,
        {{'a': 0::BIGINT, 'b': 0::BIGINT, 's': []::STRUCT(a BIGINT, b BIGINT)[]}}) AS f FROM pieces),
    spanned AS (SELECT * EXCLUDE f, (CASE WHEN contains(text, '```') THEN [] WHEN f.a >= n AND len(f.s) > 0 THEN f.s WHEN len(f.s) > 0 THEN f.s[:-2] || [{{'a': f.s[-1].a, 'b': n}}] WHEN n >= {spans.LEAST} THEN [{{'a': 0::BIGINT, 'b': n}}] ELSE [] END)[:{spans.MOST}] AS s FROM cut),
    scored AS (SELECT *, list_transform(s, lambda x: {{'o': -len(list_distinct(list_filter(regexp_extract_all(lower(substr(text, x.a + 1, x.b - x.a)), '{TERM}'), lambda t: list_contains(['eaux', 'tion', 'sch', 'cion', 'ing'], t)))), 'a': x.a, 'b': x.b,
        'c': strlen({HEAD} || ', "span": [' || x.a || ', ' || x.b || '], "offsets": "unicode_codepoints"}}]' || chr(10) || substr(text, x.a + 1, x.b - x.a))}}) AS q FROM spanned),
    ready AS (SELECT session::BIGINT AS query_id, ord, {{'u': 0::BIGINT, 'w': strlen({HEAD} || '}}]' || chr(10) || text), 'n': n, 'id': id, 'q': list_sort(list_filter(q, lambda x: x.o < 0 AND NOT (x.a = 0 AND x.b = n))),
        't': []::STRUCT(id VARCHAR, n BIGINT, complete BOOLEAN, "start" BIGINT, "end" BIGINT)[]}} AS r FROM scored),
    packed AS (SELECT query_id, list_reduce(list(r ORDER BY ord), lambda acc, x:
        CASE WHEN x.w <= 600 - acc.u - (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END)
             THEN {{'u': acc.u + x.w + (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END), 'w': 0::BIGINT, 'n': 0::BIGINT, 'id': '', 'q': acc.q, 't': acc.t || [{{'id': x.id, 'n': len(acc.t), 'complete': true, 'start': 0::BIGINT, 'end': x.n}}]}}
             WHEN len(list_filter(x.q, lambda y: y.c <= 600 - acc.u - (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END))) > 0
             THEN {{'u': acc.u + list_filter(x.q, lambda y: y.c <= 600 - acc.u - (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END))[1].c + (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END), 'w': 0::BIGINT, 'n': 0::BIGINT, 'id': '', 'q': acc.q,
                   't': acc.t || [{{'id': x.id, 'n': len(acc.t), 'complete': false, 'start': list_filter(x.q, lambda y: y.c <= 600 - acc.u - (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END))[1].a, 'end': list_filter(x.q, lambda y: y.c <= 600 - acc.u - (CASE WHEN len(acc.t) > 0 THEN 2 ELSE 0 END))[1].b}}]}}
             ELSE acc END,
        {{'u': 0::BIGINT, 'w': 0::BIGINT, 'n': 0::BIGINT, 'id': '', 'q': []::STRUCT(o BIGINT, a BIGINT, b BIGINT, c BIGINT)[], 't': []::STRUCT(id VARCHAR, n BIGINT, complete BOOLEAN, "start" BIGINT, "end" BIGINT)[]}}) AS p FROM ready GROUP BY query_id)
    SELECT query_id, t.id AS id, t.n::INTEGER AS n, t.complete AS complete, t."start"::INTEGER AS "start", t."end"::INTEGER AS "end", md5(substr(text, t."start" + 1, t."end" - t."start")) AS segment_md5
    FROM (SELECT query_id, unnest(p.t) AS t FROM packed) JOIN turns ON turns.id = t.id""")
def span_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's turns packed into 600 bytes, cut into spans where a turn doesn't fit."""
    rows = D.turns(spark, sf_dir).withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord"))
    q = rows.select("query_id", F.lit("the eaux tion of sch cion ing").alias("query")).distinct()
    return spans.pack(rows, q, 600).select("query_id", "id", "n", "complete", "start", "end", F.md5("segment").alias("segment_md5"))
