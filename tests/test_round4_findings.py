"""What the findings of round 4 named."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kelpie.llm import jaccard
from kelpie.operators import ann, dense, policy
from kelpie.sources import driver as D


def test_close_activities_keep_their_order(spark):
    """Activities that differ in the tenth digit were ranked by id."""
    e = D.entries(spark, "/root/testdata/sf0.001").limit(1).drop("id", "tier", "pinned", "status", "valid_from", "valid_until")
    fixed = [F.lit("T0").alias("tier"), F.lit(False).alias("pinned"), F.lit("active").alias("status"), *(F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_until"))]
    e = e.select("*", F.explode(F.array(*map(F.lit, "abc"))).alias("id"), *fixed)
    scores = spark.createDataFrame([("a", 1.0000000001), ("b", 1.0000000002), ("c", 1.0000000003)], "entry_id string, activity double")
    none = spark.createDataFrame([], "id string, last_hit date")
    a = policy.audit(e, scores, F.lit("2024-03-01").cast("date"), none, e.select("store", "source_hash"), demote_below=5.0)
    assert {r.id: (r["rank"], r.demote_rank) for r in a.collect()} == {"c": (1, 3), "b": (2, 2), "a": (3, 1)}


def test_entries_with_the_same_days_have_the_same_activity(spark):
    """Days were added in the order in which they came."""
    days = [(f"e{k}", f"{k}/{d}", "hit", (d * (2 * k + 1)) % 64) for k in range(64) for d in range(64)]
    uses = spark.createDataFrame(days, "entry_id string, event_id string, type string, age int")
    now = F.lit("2024-03-01").cast("date")
    uses = uses.select("entry_id", "event_id", "type", F.date_sub(now, F.col("age")).alias("t"))
    for kernel in ("bounded_power", "exponential", "mixture", "legacy"):
        assert policy.activity(uses, now, kernel).select("activity").distinct().count() == 1


def _grouped(spark, rows=400):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    return spark.createDataFrame([(k, [c + rng.gauss(0, 0.6) for c in centres[k % 12]]) for k in range(rows)], "rowid bigint, vector array<double>").repartition(3)


def test_all_queries_calibrate(spark, monkeypatch):
    """More queries than BLOCK_QUERIES were an error: the places of the others' cells were not known."""
    v = _grouped(spark)
    index = ann.build(v, cells=15)
    queries = v.filter("rowid % 5 = 0").select(F.col("rowid").alias("query_id"), "vector")
    cell = {r.rowid: r.cell for r in index.members().collect()}
    x = {r.rowid: np.array(r.vector) for r in v.collect()}
    places = []
    for q in range(0, 400, 5):
        near = sorted(x, key=lambda i: (-round(float(x[q] @ x[i]), 9), i))[:6]
        order = np.argsort(((np.floor(x[q] * ann.SCALE) - index.centroids) ** 2).sum(axis=1), kind="stable").tolist()
        places += [order.index(cell[i]) + 1 for i in near]
    places.sort()
    for block, held in ((4096, 1 << 20), (7, 40)):
        monkeypatch.setattr(dense, "BLOCK_QUERIES", block)
        monkeypatch.setattr(dense, "CELLS", held)  # some rows at a time
        for recall in (0.0, 0.5, 0.8, 0.95, 1.0):
            assert ann.calibrated(index, v, queries, 6, recall) == places[max(0, math.ceil(recall * len(places)) - 1)]
    assert len(set(places)) > 3 and ann.calibrated(index, v, queries.limit(0), 6, 0.95) == 1


def test_an_index_has_as_many_cells_as_asked_for(spark, monkeypatch):
    """Cells ended at MAX_CELLS, which the SQL does not know."""
    monkeypatch.setattr(ann, "MAX_CELLS", 3, raising=False)
    v = _grouped(spark)
    assert len(ann.build(v, rounds=0).centroids) == 20 and len(ann.build(v, cells=9, rounds=0).centroids) == 9


def test_the_sample_of_shingles_changes_no_group(spark, monkeypatch):
    """A true sample, whichever it is, gives the groups of all pairs."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    texts = [[*b[: 60 - j], *(f"x{rng.randrange(9)}" for _ in range(j))] for b in base for j in (0, 1, 3, 8, 20)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    sets = list(jaccard.shingle_sets([" ".join(t) for t in texts]))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard.linked(sets[a], sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    monkeypatch.setattr(jaccard, "HOT_AT", 1)
    found = []
    for sampled in (len(texts), 6):
        monkeypatch.setattr(jaccard, "SAMPLE_DOCS", sampled)
        found.append(len(jaccard.frequent_shingles(docs)))
        got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
        assert got == dict(enumerate(group))
    assert 0 < found[1] < found[0] and 12 < len(set(group)) < len(group)
