"""Recall: channels, fusion, re-ranking, neighbours and packing as one logical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, lexical, ranking


def gold(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id): documents that hold a question's passage literally.

    The passage's second to sixth word find the documents, as an equi-join on five-word windows; containment decides. Passages
    of fewer than seven words have no such key and are compared with every document.
    """
    q = questions.select("query_id", "passage", F.nullif(F.regexp_extract("passage", r"^\s*\S+\s+((?:\S+\s+){4}\S+)\s+\S", 1), F.lit("")).alias("key"))
    windows = F.regexp_extract_all("text", F.lit(r"(?<!\S)(?=((?:\S+\s+){4}\S+))"), F.lit(1))
    grams = docs.select("id", F.explode(F.array_distinct(F.transform(windows, lambda g: F.xxhash64(g)))).alias("g"))
    keyed = q.filter("key IS NOT NULL").select("query_id", "passage", F.xxhash64("key").alias("g"))
    found = grams.join(keyed, "g").select("query_id", "passage", "id").join(docs.select("id", "text"), "id").filter(F.contains("text", "passage")).select("query_id", "id").distinct()
    short = q.filter("key IS NULL")
    return found.union(docs.select("id", "text").join(short, F.contains(F.col("text"), F.col("passage"))).select("query_id", "id"))


def candidates(docs: DataFrame, queries: DataFrame, mode: str, k: int = 100, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """(query_id, rowid, rank): the fused candidates of ``literal``, ``sparse``, ``dense`` or ``hybrid`` retrieval."""
    found = None
    if mode != "dense":
        found = lexical.channels(docs, queries, mode, k, stem).select("query_id", "channel", "rowid", "rank")
    if mode in ("dense", "hybrid"):
        near = dense.top_k(vectors, query_vectors, k).select("query_id", F.lit("dense").alias("channel"), "rowid", "rank")
        found = near if found is None else found.unionByName(near)
    return ranking.rrf(found)


def recall(
    docs: DataFrame, queries: DataFrame, mode: str = "sparse", budget: int = 600, k: int = 100, reach: int = 0,
    entities: bool = False, temporal: bool = False, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, stem: bool = True,
) -> DataFrame:
    """(query_id, selected_ids, context, budget_used) of each query; a query without a candidate has no row."""
    if not 1 <= k <= 1000 or not 0 <= budget <= 32768 or reach not in (0, 1, 2) or mode not in ("literal", "sparse", "dense", "hybrid"):
        raise ValueError("options are out of range")
    ranked = candidates(docs, queries, mode, k, vectors, query_vectors, stem).select("query_id", "rowid", "rank")
    full = lambda r: r.join(docs.select("rowid", "id", "speaker", "timestamp", "text"), "rowid")
    if entities:
        ranked = ranking.entity_reorder(full(ranked), queries)
    if temporal:
        ranked = ranking.temporal_reorder(full(ranked), queries).select("query_id", "rowid", "rank")
    if reach:
        ranked = ranking.neighbours(ranked, docs, reach)
    return ranking.pack(full(ranked), budget)
