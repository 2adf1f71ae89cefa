"""BM25 in blocks and chunks of any size gives the same rows, and phrases are found where a plain search finds them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import lexical


def corpus(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta-one", "run", "runs", "running", "日本", "é", "one"]
    docs = [(k, f"d{k % 90:03d}" if k < 90 else f"e{k}", f"s{k % 3}" if k % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(25))), rng.choice(words)) for k in range(200)]
    asked = [(q, f"s{q % 4}", sorted({rng.choice([*words, "alpha beta", "beta beta", "zzz", "..."]) for _ in range(5)})) for q in range(23)]
    return spark.createDataFrame(docs, "rowid bigint, id string, scope string, text string, meta string").repartition(5), spark.createDataFrame(asked, "query_id bigint, scope string, terms array<string>")


def told(df):
    return sorted(tuple(r[c] for c in ("channel", "query_id", "rank", "rowid", "id", "score")) for r in df.collect())


@pytest.mark.parametrize(("stem", "scope"), [(False, "corpus"), (True, "scope")])
def test_blocks_and_chunks(spark, monkeypatch, stem, scope):
    docs, asked = corpus(spark)
    run = lambda: told(lexical.bm25_channels(docs, asked, ["text", "meta"], {"a": ("terms", [1.0, 0.5]), "b": ("terms", [1.0, 0.0])}, 7, stem, scope))
    whole = run()
    assert len(whole) > 200 and {r[0] for r in whole} == {"a", "b"}
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(lexical, "PAIRS", 40)
    assert run() == whole


def test_scores_equal_the_formula(spark):
    docs, asked = corpus(spark)
    got = told(lexical.bm25(docs, asked.filter("query_id = 1"), [("text", 1.0), ("meta", 0.25)], "terms", 1000).withColumn("channel", F.lit("")))
    rows = docs.collect()
    toks = {r.rowid: [[w for w in x.lower().replace("-", " ").split()] for x in (r.text, r.meta)] for r in rows}
    average = sum(len(a) + len(b) for a, b in toks.values()) / len(rows)
    terms = [t.replace("-", " ").split() for t in asked.filter("query_id = 1").first().terms]
    terms = [t for t in terms if any(c.isalnum() for c in "".join(t))]
    at = lambda words, t: sum(words[i : i + len(t)] == t for i in range(len(words)))
    want = {}
    for t in terms:
        f = {r.rowid: (at(toks[r.rowid][0], t), at(toks[r.rowid][1], t)) for r in rows}
        df = sum(a + b > 0 for a, b in f.values())
        idf = np.log((len(rows) - df + 0.5) / (df + 0.5)) if df else 0
        idf = idf if idf > 0 else 1e-6
        for r in rows:
            a, b = f[r.rowid]
            if a + b and r.scope == "s1":
                n = a + 0.25 * b
                length = sum(map(len, toks[r.rowid]))
                want[r.rowid] = want.get(r.rowid, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / average))
    assert {r[3]: r[5] for r in got} == pytest.approx(want, abs=2e-9) and [r[2] for r in got] == list(range(1, len(want) + 1))


def test_nothing_asked_and_nothing_there(spark):
    docs, asked = corpus(spark)
    none = asked.filter("query_id < 0")
    assert lexical.bm25(docs, none, [("text", 1.0)], "terms").count() == 0
    assert lexical.bm25(docs.limit(0), asked, [("text", 1.0)], "terms").count() == 0
    assert lexical.bm25(docs, asked.withColumn("terms", F.array(F.lit("..."))), [("text", 1.0)], "terms").count() == 0
