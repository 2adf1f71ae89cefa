"""Exact vector search and the measures that compare approximate results with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that one pass over the vectors answers.
BLOCK_QUERIES = 4096
#: Scores that a task holds at once.
CELLS = 1 << 20


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: in a lambda an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalised(vector: Column) -> Column:
    """Scaled by the largest magnitude, then to unit length; an error for empty, non-finite and zero vectors."""

    def unit(scaled: Column) -> Column:
        return _let(F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(scaled, lambda x: x / norm))

    def checked(v: Column) -> Column:
        return _let(F.array_max(F.transform(v, F.abs)), lambda top: sound(v, top))

    def sound(v: Column, top: Column) -> Column:
        good = (F.size(v) > 0) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (top > 0)
        checks = F.assert_true(F.coalesce(good, F.lit(False)), F.lit("vectors must be non-empty, finite and non-zero")).isNull()
        return F.when(checks, _let(F.transform(v, lambda x: x / top), unit))

    return _let(F.transform(vector, lambda x: x.cast("double")), checked)


def is_unit(vector: Column, dimension: int) -> Column:
    return (F.size(vector) == dimension) & (F.abs(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)) - 1) <= 1e-4)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def matrix(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with their vectors of the same content hash; an error if any document lacks one."""
    joined = docs.join(vectors, ["scope", "id", "hash"], "left")
    return joined.filter(F.assert_true(F.col("vector").isNotNull(), F.lit("embeddings are incomplete")).isNull())


def missing_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents without a vector of their present content."""
    return docs.join(vectors.select("id", "hash"), ["id", "hash"], "left_anti")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "rowid", vector_col: str = "vector", query_id: str = "query_id") -> DataFrame:
    """(query_id, rowid, score, rank) of the ``k`` largest dot products; ties in row order.

    Queries go to every partition of the vectors in blocks of about BLOCK_QUERIES (a bounded broadcast), as one matrix
    product for some rows at a time with a local top-k, so that only k rows per query and partition move; the exact merge ranks those.
    """
    blocks = -(-queries.count() // BLOCK_QUERIES)
    part = F.pmod(F.xxhash64(query_id), F.lit(max(blocks, 1)))
    best = None
    for i in range(blocks):
        block = _local_top_k(vectors, queries.filter(part == i), k, id_col, vector_col, query_id)
        best = block if best is None else best.union(block)
    if best is None:
        kind = queries.schema[query_id].dataType.simpleString()
        return vectors.sparkSession.sql(f"SELECT CAST(NULL AS {kind}) AS {query_id}, CAST(NULL AS BIGINT) AS rowid, CAST(NULL AS DOUBLE) AS score, 1 AS rank WHERE false")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "rowid")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The ``k`` best rows so far of each of ``n`` queries; takes some rows at a time, so that memory is bounded whatever is added."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)  # what a row must reach to count
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, who: np.ndarray | None = None) -> None:
        """Rows ``x`` with ``ids`` for the queries ``who`` of ``q``, or for all."""
        who = np.arange(len(q)) if who is None else who
        for first in range(0, len(who), CELLS):
            asking = who[first : first + CELLS]
            step = max(1, CELLS // max(1, len(asking)))
            for a in range(0, len(x), step):
                scores = np.round(q[asking] @ x[a : a + step].T, 9)
                at, row = np.nonzero(~(scores < self.least[asking, None]))
                if len(at):
                    self._merge(asking[at], scores[at, row], ids[a + row])

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.append(self.query, query), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.query, self.score, self.id = query[place < self.k], score[kept], ids[kept]
        self.least[query[place == self.k - 1]] = score[last]

    def rows(self, names: np.ndarray, query_id: str = "query_id", size: int = 100_000) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.query), size):
            at = slice(a, a + size)
            yield pa.RecordBatch.from_arrays([pa.array(names[self.query[at]]), pa.array(self.id[at]), pa.array(self.score[at])], names=[query_id, "rowid", "score"])


def _local_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str) -> DataFrame:
    asked = queries.select(query_id, vector_col).toPandas()
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rowid bigint, score double"
    names = asked[query_id].to_numpy()
    q = np.stack([np.asarray(v, dtype=np.float64) for v in asked[vector_col]]) if len(asked) else np.empty((0, 0))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for batch in batches:
            if batch.num_rows and len(names):
                best.add(q, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64), batch.column(0).to_numpy())
        yield from best.rows(names, query_id)

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(local, schema)


def ann_quality(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per query: recall of the reference's ids, overlap, symmetric difference and mean rank shift of shared ids."""
    r = reference.groupBy("query_id").agg(F.collect_list(F.struct("rank", "rowid")).alias("r"))
    c = candidate.groupBy("query_id").agg(F.collect_list(F.struct("rank", "rowid")).alias("c"))
    both = r.join(c, "query_id", "left").withColumn("c", F.coalesce("c", F.array().cast(r.schema["r"].dataType)))
    a, b = F.col("r.rowid"), F.col("c.rowid")
    shared = F.array_intersect(a, b)
    at = lambda arr, x: F.element_at(F.filter(arr, lambda s: s["rowid"] == x), 1)["rank"]
    shift = F.aggregate(F.transform(shared, lambda x: F.abs(at(F.col("r"), x) - at(F.col("c"), x)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select(
        "query_id",
        F.try_divide(F.size(shared), F.size(a)).alias("recall"),
        F.size(shared).alias("overlap"),
        (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).alias("symmetric_difference"),
        F.try_divide(shift, F.size(shared)).alias("mean_rank_shift"),
    )
