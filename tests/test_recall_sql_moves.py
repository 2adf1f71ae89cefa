"""Recall from SQL text scores documents where they are, and gives the same rows however they are dealt."""

import re

import pytest
from pyspark.sql import functions as F

from kelpie.plans import recall as R
from kelpie.plans import table_functions as T

WORDS = ["alpha", "beta", "gamma", "delta_one", "running", "runs", "the", "天気の", "ray", "ann"]


@pytest.fixture(scope="module")
def views(spark):
    T.register(spark)
    rows = [(k, f"id{k}", "conv", f"s{k // 5}", k % 5, " ".join(WORDS[(k * j) % 10] for j in range(1, 2 + k % 7)), ("ann", "bob")[k % 2], "2024-01-01", "src", "T1") for k in range(60)]
    docs = spark.createDataFrame(rows, "rowid bigint, id string, scope string, session string, ord int, text string, speaker string, timestamp string, source string, tier string")
    questions = spark.createDataFrame([(k, " ".join(WORDS[k : k + 3])) for k in range(8)], "query_id bigint, query string")
    docs.createOrReplaceTempView("m_docs")
    questions.createOrReplaceTempView("m_questions")
    return docs, questions


@pytest.mark.parametrize("mode", ["literal", "sparse"])
def test_tokens_and_scores_stay_where_documents_are(spark, views, mode):
    plan = spark.sql(T.recall_sql("m_docs", "m_questions", mode, 300, reach=1))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    names = [[k.split("#")[0].strip() for k in x.split(",")] for x in keys]
    assert ["rowid"] in names
    assert not [n for n in names if "token" in n or {"rowid", "phrase"} <= set(n) or {"query_id", "channel", "rowid"} <= set(n)]


@pytest.mark.parametrize(("mode", "reach", "parts", "few"), [("sparse", 1, 7, False), ("sparse", 2, 1, True), ("literal", 0, 5, True), ("literal", 1, None, False)])
def test_rows_do_not_depend_on_how_documents_are_dealt(spark, views, mode, reach, parts, few):
    docs, questions = views
    shown = lambda df: sorted((r.query_id, tuple(r.selected_ids), r.context, r.budget_used) for r in df.collect())
    want = R.recall(docs, questions.withColumn("scope", F.lit("conv")), mode, 300, 10, reach)
    assert shown(spark.sql(T.recall_sql("m_docs", "m_questions", mode, 300, 10, reach, parts, few))) == shown(want)


def test_a_task_gets_a_bounded_number_of_documents(spark, monkeypatch):
    from kelpie.queries import QUERIES
    from kelpie.sources import driver as D

    sf = "/root/testdata/sf0.001"
    n = D.turns(spark, sf).count()
    monkeypatch.setattr(T, "TASK_DOCS", 20)
    plan = QUERIES["recall_literal_sql"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(x) for x in re.findall(r"Exchange hashpartitioning\(rowid#\d+L?, (\d+)\), REPARTITION", plan)]
    assert dealt and set(dealt) == {max(4, n // 20 + 1)}


@pytest.mark.parametrize("name", ["recall_literal_sql", "recall_sparse_sql"])
def test_a_task_gets_a_bounded_number_of_questions_at_once(spark, monkeypatch, name):
    from kelpie.operators import lexical
    from kelpie.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(T, "BLOCK_QUESTIONS", 15, raising=False)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 15)
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    names = [[k.split("#")[0].strip() for k in x.split(",")] for x in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)]
    assert plan.count("BatchEvalPythonUDTF recall_fused") == 3  # 40 questions
    assert not [n for n in names if "token" in n or {"rowid", "phrase"} <= set(n) or {"query_id", "channel", "rowid"} <= set(n)]
    assert sorted(map(tuple, df.collect())) == want
