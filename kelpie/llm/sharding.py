"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

A uniform random shuffle of N rows into S shards of fixed sizes sends a random number of rows from each input partition
to each shard. Those numbers follow the multivariate hypergeometric law given both margins, so they are drawn first, as
a partitions x shards matrix. Every partition then permutes its own rows and deals them by its row of the matrix; after
the exchange, every shard permutes again. Shard sizes differ by one row at most (law ``rows``) and every assignment with
these sizes is equally likely, up to the precision of doubles in the chances. The draw and both permutations depend on the seed and the rows alone.

The matrix has a row per input partition and goes back into the plan as a table; the driver sees counts per partition,
never rows. The second permutation is split into buckets of the random order, so a shard of any size is ranked by many
tasks.

Edge cases: a null text counts no bytes; repeated rows and equal texts are separate rows, told apart by their place;
fewer rows than shards leave some shards empty; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prefix_totals, written

#: Rows that one ranking task of the second permutation takes on average.
BUCKET_ROWS = 50_000


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's sqrt(2 pi n) (n / e) ** n."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1.0 / n
    return x / 12 - x**3 / 360 + x**5 / 1260 - x**7 / 1680


def _deviance(x: int, total: int, part: int, whole: int) -> float:
    """x ln(x / m) + m - x for m = total * part / whole, without loss where x is near m; x and m above 0."""
    v = (x * whole - total * part) / (x * whole + total * part)  # exact integers until the division
    if abs(v) > 0.1:
        m = total * part / whole
        return x * math.log(x * whole / (total * part)) + m - x
    term, out, k = 2 * x * v, (x * whole - total * part) / whole * v, 1
    while True:
        term *= v * v
        if (new := out + term / (2 * k + 1)) == out:
            return out
        out, k = new, k + 1


def _log_binomial(x: int, n: int, part: int, whole: int) -> float:
    """ln of the chance of x among n draws of chance part / whole each, by the saddle-point expansion."""
    if x == 0:
        return n * math.log1p(-part / whole) if part < whole else (0.0 if n == 0 else -math.inf)
    if x == n:
        return n * math.log(part / whole)
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n, part, whole) - _deviance(n - x, n, whole - part, whole)
    return rest + 0.5 * (math.log(n / (n - x)) - math.log(2 * math.pi * x))


def log_chance(k: int, good: int, bad: int, n: int) -> float:
    """ln of the chance of k good ones among n of good + bad, to about fifteen digits at any size."""
    total = good + bad
    if n == total or not good or not bad:
        return 0.0 if k == (n if not bad else 0 if not good else good) else -math.inf
    return _log_binomial(k, good, n, total) + _log_binomial(n - k, bad, n, total) - _log_binomial(n, total, n, total)


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """numpy's sampler where its range allows, else inversion from the mode outwards."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p0 = math.exp(log_chance(mode, good, bad, n))
    while True:
        # What sums of doubles leave open beyond both ends (below 1e-9) is drawn anew.
        u, left, right, p_left, p_right = rng.random() - p0, mode, mode, p0, p0
        if u <= 0:
            return mode
        while (right < high and p_right > 0) or (left > low and p_left > 0):
            if right < high:
                p_right *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
                right += 1
                if (u := u - p_right) <= 0:
                    return right
            if left > low:
                p_left *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
                left -= 1
                if (u := u - p_left) <= 0:
                    return left


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts sent from partition i to shard j: row sums are ``sizes``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    left = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    out = np.zeros((len(sizes), n_shards), dtype=np.int64)
    for i, n in enumerate(sizes):
        rest = sum(left)
        for j in range(n_shards):
            rest -= left[j]
            out[i, j] = k = _hypergeometric(left[j], rest, n, rng)
            n -= k
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
    return out


def uniform_shards(docs: DataFrame, n_shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "rows",
    )
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    matrix = communication_matrix([n for _, n in counts], n_shards, seed)
    ends = np.cumsum(matrix, axis=1)
    parts = pa.array([p for p, _ in counts], pa.int32())
    dealt = spark.createDataFrame(pa.table({"part": parts, "ends": pa.array(list(ends), pa.list_(pa.int64()))}))
    total = int(matrix.sum())
    buckets = max(1, -(-total // (n_shards * BUCKET_ROWS)))
    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "doc_id", "place"), "place")
    moved = (
        rows.withColumn("rank", F.row_number().over(first))
        .join(dealt, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
        .withColumn("key", F.xxhash64(F.lit(seed + 1), "place", "doc_id"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 33), F.lit(buckets)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "bucket", "key", "place")
    )
    starts = prefix_totals(moved.groupBy("shard", "bucket").count(), ["bucket"], "count", "start", ["shard"]).drop("count")
    second = Window.partitionBy("shard", "bucket").orderBy("key", "place")
    return (
        moved.withColumn("n", F.row_number().over(second))
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("start") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
