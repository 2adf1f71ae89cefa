"""Importance resampling of documents towards a target's distribution of hashed features.

Features are all runs of 1 to ``longest`` consecutive words (A-Z lowered, repeats counted); the bucket of one is the CRC-32
of its UTF-8 bytes modulo ``buckets``. The sparse document-by-bucket count matrix is persisted once, as CSR blocks: a row of
the table holds some documents with the row pointer, the bucket numbers and the counts of their part of the matrix. Column
sums of the blocks give the source's distribution, those of the target's texts the target's; a bucket's gain is the logarithm
of the ratio of both, smoothed by one, in thousandths. The product of the matrix with the gains gives each document's
weight, and a Gumbel number drawn from its identifier makes the largest sums a sample without replacement.

Texts are read once. What moves between tasks are at most ``buckets`` sums a partition and one narrow row per document: ranks
come from range partitions of the scores and running totals per partition, so no task orders all documents.

Edge cases: a null or empty text has no features and weight 0; documents with fewer than ``least_words`` words are scored,
never drawn; ties go to the smaller identifier, a null identifier (drawn like the empty string) comes last, and rows alike in
both take ranks one after the other; repeated rows count as documents of their own; an empty table gives an empty result, an
empty target gives gains from the smoothing alone; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, prefix_totals
from .shingles import text_chunks

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text in a CSR block, and words whose bucket a task remembers.
BLOCK_BYTES, REMEMBERED = 8 << 20, 1 << 20

#: Digits, lower-case letters and bytes above 0x7F stay, A-Z are lowered, all else parts words.
_WORD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class Buckets(dict):
    """Bucket of a feature; what it remembers is bounded."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        parts = []
        for n in range(1, min(longest, len(words)) + 1):
            runs: Iterable[bytes] = words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
            parts.append(np.fromiter(map(self.__getitem__, runs), np.int64, len(words) - n + 1))
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _csr(buckets: int, longest: int):
    number = np.min_scalar_type(max(1, buckets - 1)).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            for row, texts in text_chunks(batch.column(1).cast(pa.binary()), BLOCK_BYTES):
                split = [words_of(t) for t in texts]
                found = [known.of(w, longest) for w in split]
                keys, counts = np.unique(np.concatenate(found) + np.repeat(np.arange(len(found)) * buckets, list(map(len, found))), return_counts=True)
                indptr = np.searchsorted(keys, np.arange(len(found) + 1) * buckets).astype("<i8")
                ids = batch.column(0).slice(row, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])),
                        pa.array([list(map(len, split))], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (indptr, (keys % buckets).astype(number), counts.astype("<u4"))),
                    ],
                    names=["ids", "n_words", "indptr", "indices", "counts"],
                )

    return run


def csr_blocks(docs: DataFrame, tables: Tables, name: str, buckets: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """The count matrix of ``docs`` in CSR blocks, a table."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return tables.written(rows.mapInArrow(_csr(buckets, longest), f"ids array<{id_type}>, n_words array<bigint>, indptr binary, indices binary, counts binary"), name)


def _numbers(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), dtype=kind)


def _index_kind(buckets: int):
    return np.min_scalar_type(max(1, buckets - 1)).newbyteorder("<")


def column_sums(blocks: DataFrame, buckets: int) -> list[int]:
    """Count of each bucket over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for indices, counts in zip(batch.column(0), batch.column(1), strict=True):
                # Sums of a block are far below 2 ** 53, so the doubles of bincount are exact.
                total += np.bincount(_numbers(indices, _index_kind(buckets)), _numbers(counts, "<u4"), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    sums = blocks.select("indices", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(ratio)) of the smoothed shares of each bucket."""
    s_all, t_all = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)]


def gumbel(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighted(gain: list[int], seed: int):
    gain_of, kind = np.array(gain, dtype=np.int64), _index_kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words = batch.column("ids")[k].values, batch.column("n_words")[k].values
                indptr, indices, counts = (_numbers(batch.column(c)[k], d) for c, d in (("indptr", "<i8"), ("indices", kind), ("counts", "<u4")))
                n = np.append(0, np.cumsum(counts, dtype=np.int64))[indptr]
                w = np.append(0, np.cumsum(gain_of[indices] * counts.astype(np.int64)))[indptr]
                weight = np.diff(w)
                score = weight + np.array([gumbel(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, words, *(pa.array(x, pa.int64()) for x in (np.diff(n), weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """A row per document: doc_id, n_features, weight, score, and rank among the drawn ``percent`` of eligible ones, else null."""
    tables = Tables(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = csr_blocks(docs, tables, "csr", buckets, longest, id_col, text_col)
    asked = target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text"))
    wanted = csr_blocks(asked, tables, "target", buckets, longest, "doc_id", "text")
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    weighted = blocks.mapInArrow(_weighted(gain, seed), f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint")
    scores = tables.written(weighted.withColumn("row", F.monotonically_increasing_id()), "scores")
    tables.delete("csr")
    tables.delete("target")

    # Rank: place in the range partition, and the rows of the partitions before it.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    eligible = F.col("n_words") >= least_words
    ranged = scores.filter(eligible).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = tables.written(ranged.withColumn("part", F.shiftright("at", 33)), "placed")
    counts = placed.groupBy("part").count()
    before = prefix_totals(counts, ["part"], "count", "before").drop("count")
    n_drawn = percent * placed.count() // 100
    rank = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    ranked = placed.join(before, "part").withColumn("rank", F.when(rank <= n_drawn, rank))
    rest = scores.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).union(rest.select(*out))
