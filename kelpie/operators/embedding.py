"""Embedding tables: incremental encoding with any encoder, a cache of equal inputs, packed vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], "np.ndarray"]


def encoded(texts: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(hash, vector) of the distinct texts of ``texts`` (hash, text): each text is encoded once, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                vectors = np.asarray(encoder(part["text"].tolist()), dtype=np.float64)
                if len(vectors) != len(part) or not np.isfinite(vectors).all():
                    raise ValueError("the encoder must give one finite vector for each text")
                yield pd.DataFrame({"hash": part["hash"], "vector": list(vectors)})

    return texts.dropDuplicates(["hash"]).select("hash", "text").mapInPandas(run, "hash string, vector array<double>")


def refreshed(docs: DataFrame, vectors: DataFrame, encoder: Encoder) -> DataFrame:
    """The vectors (id, hash, vector) of all present contents: known ones stay, only changed contents are encoded."""
    known = docs.select("id", "hash").join(vectors.select("id", "hash", "vector"), ["id", "hash"])
    todo = docs.join(vectors.select("id", "hash"), ["id", "hash"], "left_anti").select("id", "hash", "text")
    new = todo.select("id", "hash").join(encoded(todo, encoder), "hash")
    return known.select("id", "hash", "vector").unionByName(new.select("id", "hash", "vector"))


def cached(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs (seq, text) with vectors that the cache (hash, vector) has, and one row of hits and misses of distinct inputs."""
    hashed = inputs.withColumn("hash", F.sha2("text", 256))
    j = hashed.join(cache, "hash", "left")
    counts = j.groupBy("hash").agg(F.max(F.col("vector").isNotNull()).alias("hit")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return j, counts


def from_json(rows: DataFrame) -> DataFrame:
    """Vectors stored as JSON text, as arrays; a broken one is an error."""
    return rows.withColumn("vector", F.from_json("vector", "array<double>", {"mode": "FAILFAST"}))


def packed(rows: DataFrame) -> DataFrame:
    """``vector`` as little-endian 32-bit floats in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "id string, vector binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """The inverse of ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(v, "<f4").astype(np.float64).tolist() for v in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "id string, vector array<double>")
