"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition makes one run: its digests in order, each with the best row seen and a count. Runs then merge
``fan_in`` at a time: in round r the runs whose numbers agree after dividing by ``fan_in ** r`` exchange their entries,
equal digests combine and the better identifier survives, so copies of a text leave one entry a run; texts without copies
keep theirs, and each of the rounds (as many as the logarithm of the partitions) moves these digests again. No task ever
holds more than its share of a run. An entry is *verified*: rows combine only where SHA-256, a second independent
64-bit hash and the length of the normalised text all agree.

Of equal texts the row with the most code points in its original text stays, then the smallest identifier.

Edge cases: a null text is the empty text; a null identifier sorts after all others; repeated rows form a group like any
other copies (each repeated row gets a result row, and all rows that carry the kept identifier and text are marked
kept by ``exact_groups``; ``keep_one`` still returns one of them); an empty table gives an empty result; columns of
the input other than the two named are not read by ``exact_groups`` and pass unchanged through ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, fresh, spread_join, written

FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _leaf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("second"),
        F.octet_length(norm).alias("n_bytes"),
    )


_KEY = ["digest", "second", "n_bytes"]


def merge_runs(leaf: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: the key, the kept row and the group's size. ``leaf`` must be stable on re-reading."""
    n_runs = (leaf.agg(F.max("run").alias("m")).first().m or 0) + 1
    best = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    runs = leaf.select(*_KEY, "run", best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*_KEY, "run")
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        if n_runs <= 1:
            break
    return runs.select(*_KEY, F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_points"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    leaf = written(_leaf(docs, id_col, text_col), "digest_runs")
    merged = merge_runs(leaf, fan_in)
    # A text with very many copies meets copies of its result row.
    return spread_join(leaf, merged, _KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key, digest, keep, points, n = fresh(docs, "key", "digest", "keep", "points", "n")
    leaf = written(_leaf(docs, id_col, text_col), "digest_runs")
    kept = merge_runs(leaf, fan_in).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("keep_points").alias(points))
    marked = docs.withColumn(key, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    rows = marked.join(
        kept,
        (F.col(key) == F.col(digest))
        & F.col(id_col).eqNullSafe(F.col(keep))
        & (F.length(F.coalesce(F.col(text_col), F.lit(""))) == F.col(points)),
    )
    # Fully repeated rows share identifier and text; one of them stays.
    w = Window.partitionBy(key, keep, points).orderBy(F.lit(1))
    return rows.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
