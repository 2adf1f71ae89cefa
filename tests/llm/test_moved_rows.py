"""Near groups move only what their joins can use, whether the identifiers are few or many."""

import pytest

from kelpie.llm import jaccard, minhash


def _texts():
    words = [f"w{k * 37 % 401}" for k in range(400)]
    base = {d: " ".join(words[d * 3 : d * 3 + 40]) + f" tail{d}" for d in range(0, 100, 2)}
    return base | {d + 1: t.replace("tail", "end") for d, t in base.items() if d % 10 == 0}


@pytest.mark.parametrize("small", [3, 1_000_000])
def test_only_rows_of_asked_identifiers_stay(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_IDS", small)
    rows = spark.range(2000).selectExpr("id AS doc_id", "cast(id AS string) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'none'"))
    ids = spark.createDataFrame([(k,) for k in (5, 5, 17, 900, 1999, 3000)], "doc_id bigint")
    kept = jaccard.among(rows, ids)
    assert kept.columns == rows.columns
    got = {r.doc_id for r in kept.collect()}
    # With 3 * 64 bits of which at most 5 are set, about one of 40 other rows stays.
    assert {5, 17, 900, 1999} <= got and len(got) < (4 + 1 if small > 3 else 150)


def test_groups_are_the_same_for_many_identifiers(spark, monkeypatch):
    docs = spark.createDataFrame(list(_texts().items()), "doc_id bigint, text string")
    want = sorted(map(tuple, minhash.fingerprints(docs).collect()))
    assert sum(r[0] != r[-1] for r in want) >= 10
    monkeypatch.setattr(jaccard, "SMALL_IDS", 3)
    monkeypatch.setattr(minhash, "SMALL_IDS", 3)
    assert sorted(map(tuple, minhash.fingerprints(docs).collect())) == want
