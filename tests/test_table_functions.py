"""SQL text with the table functions against the same recall as DataFrame operations."""

import pytest

from kelpie.plans import recall as R
from kelpie.plans import table_functions as T

TURNS = [
    ("alpha beta_one gamma", "ann"), ("the beta-one of alpha", "bob"), ("日本語の天気 alpha", "ann"), ('quote " back\\ slash\nline', "zoé"), ("", "ann"), ("alpha alpha alpha running runs", "bob"),
    ("beta one two", "ann"), ("何か 天気 です", "bob"), ("run alpha and gamma ray", None), ("x" * 700 + " gamma", "ann"),
]
QUESTIONS = [(1, "where is alpha run by ann"), (2, "beta-one"), (3, "天気"), (4, "gamma"), (5, "nothing there"), (6, "the of and"), (7, "ann")]


@pytest.fixture(scope="module")
def views(spark):
    T.register(spark)
    rows = [(k, f"id{k}", "conv", f"s{k // 4}", k % 4, t, s or "", "2024-01-01" if k % 2 else "", "src", "T1") for k, (t, s) in enumerate(TURNS)]
    docs = spark.createDataFrame(rows, "rowid bigint, id string, scope string, session string, ord int, text string, speaker string, timestamp string, source string, tier string")
    questions = spark.createDataFrame(QUESTIONS, "query_id bigint, query string")
    docs.createOrReplaceTempView("t_docs")
    questions.createOrReplaceTempView("t_questions")
    return docs, questions


def shown(df):
    return sorted((r.query_id, tuple(r.selected_ids), r.context, r.budget_used) for r in df.collect())


@pytest.mark.parametrize(("mode", "reach", "budget", "k"), [("literal", 0, 300, 100), ("sparse", 1, 600, 100), ("sparse", 2, 120, 2), ("sparse", 0, 0, 1)])
def test_sql_text_equals_the_plan(spark, views, mode, reach, budget, k):
    from pyspark.sql import functions as F

    docs, questions = views
    want = R.recall(docs, questions.withColumn("scope", F.lit("conv")), mode, budget, k, reach)
    assert shown(spark.sql(T.recall_sql("t_docs", "t_questions", mode, budget, k, reach))) == shown(want)


def test_packs_skip_what_does_not_fit(spark, views):
    rows = [(1, 1, "a", "12345"), (1, 2, "b", "é" * 50), (1, 3, "c", "123"), (2, 1, "d", "x" * 99), (3, 2, "f", "22"), (3, 1, "e", "1")]
    spark.createDataFrame(rows, "query_id bigint, rank int, id string, block string").createOrReplaceTempView("t_blocks")
    got = shown(spark.sql("SELECT * FROM pack_budget(TABLE(t_blocks) PARTITION BY (query_id) ORDER BY (rank), 10)"))
    assert got == [(1, ("a", "c"), "12345\n\n123", 10), (2, (), "", 0), (3, ("e", "f"), "1\n\n22", 5)]


def test_channels_are_cut_and_fused_with_ties_by_id(spark, views):
    rows = [(1, "a", 10, "x", 2.0), (1, "a", 11, "w", 2.0), (1, "a", 12, "v", 1.0), (1, "b", 12, "v", 5.0), (2, "a", 7, "q", 0.5)]
    spark.createDataFrame(rows, "query_id bigint, channel string, rowid bigint, id string, score double").createOrReplaceTempView("t_scored")
    got = sorted((r.query_id, r["rank"], r.rowid, round(r.score, 9)) for r in spark.sql("SELECT * FROM recall_fused(TABLE(t_scored) PARTITION BY (query_id), 2)").collect())
    one, two = round(1 / 61, 9), round(1 / 62, 9)
    assert got == [(1, 1, 11, one), (1, 2, 12, one), (1, 3, 10, two), (2, 1, 7, one)]


def test_options_out_of_range():
    for options in ({"mode": "dense"}, {"k": 0}, {"budget": -1}, {"reach": 3}):
        with pytest.raises(ValueError, match="out of range"):
            T.recall_sql("d", "q", **options)
