"""The pipeline's stages against plain decisions, and its rules."""

import brute
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from kelpie.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def squeeze(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    weights = queries.toxicity_weights(spark, docs, SF)
    bad = {r.doc_id for r in toxicity.scores(docs, weights).filter("predicted = 1").collect()}

    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == cols and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    left = {}
    for r in clean.collect():
        k = squeeze(r.text)
        left[k] = min(left.get(k, (0, 10**9)), (-len(r.text or ""), r.doc_id))
    unique = stages["exact dedup"](spark, clean, SF)
    assert unique.columns == cols and {r.doc_id for r in unique.collect()} == {d for _, d in left.values()}

    rows = [(r.doc_id, r.text) for r in unique.collect()]
    firsts = {c for _, c in brute.near_groups(rows).values()}
    near = stages["n-gram Jaccard join"](spark, unique, SF)
    assert near.columns == cols and {r.doc_id for r in near.collect()} == firsts

    private = stages["PII"](spark, near, SF)
    assert private.columns == cols
    want = {r.doc_id: r.text for r in pii.findings(near, queries.PII_KEY).collect()}
    assert {r.doc_id: r.text for r in private.collect()} == want

    packed = stages["best-fit packing"](spark, private, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == firsts


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert corpus_pipeline.ORACLE_SQL is None and public_tokenizers.PATTERN
