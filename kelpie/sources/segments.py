"""Immutable vector segments as a Spark data source (format ``vector_segment``).

A segment is a file of one task: a magic, the length of its header, the header as JSON, and blocks of rows. The header has the
profile, the generation, the dimension, and for each block its rows, place, length and SHA-256; a block has its row numbers as
64-bit integers and then their vectors as 32-bit floats, all little-endian. A file is named by its own SHA-256.

A write leaves its segments and a manifest; the manifest becomes the current one only when it is published, by one rename, so
readers see either the old set or the new. Each task reads back what it wrote before it reports it. A read has one partition
for each block, which reads its bytes alone and checks their hash: a damaged block is an error that names it, and only the
tasks that need it fail. ``migrated`` copies to another place and publishes there once every row has been read back and compared.

Options: ``path`` (any that pyarrow's file systems can open; all executors must see it), ``profile`` and ``generation`` (what the
manifest must have, if given), ``manifest`` (one that is not published, by name), ``publish`` (true), ``blockRows`` (8192).
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, CURRENT = b"KLPSEG01", "CURRENT"
MAX_HEADER = 16 << 20
SCHEMA = "rowid bigint, vector array<float>"


def opened(path: str):
    """pyarrow's file system of ``path`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    at, name = opened(path)
    with at.open_input_stream(name) as f:
        return f.read()


def header_of(path: str, size: int | None = None) -> tuple[dict, int]:
    """The header of a segment and the place of its first block."""
    at, name = opened(path)
    with at.open_input_file(name) as f:
        start = f.read(len(MAGIC) + 4)
        if len(start) < len(MAGIC) + 4 or start[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path}: not a segment")
        (length,) = struct.unpack("<I", start[len(MAGIC) :])
        if length > min(MAX_HEADER, f.size() - len(start)):
            raise ValueError(f"{path}: invalid header length")
        try:
            header = json.loads(f.read(length))
        except ValueError as e:
            raise ValueError(f"{path}: broken header") from e
        base = len(start) + length
        if f.size() != base + sum(b["length"] for b in header["blocks"]):
            raise ValueError(f"{path}: truncated segment")
    return header, base


def block_of(path: str, number: int, offset: int, length: int, sha256: str, rows: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of a block, after its hash is checked."""
    at, name = opened(path)
    with at.open_input_file(name) as f:
        f.seek(offset)
        raw = f.read(length)
    if len(raw) != length or hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path}: checksum mismatch in block {number}")
    return np.frombuffer(raw, "<i8", rows), np.frombuffer(raw, "<f4", rows * dimension, 8 * rows).reshape(rows, dimension)


def manifest_of(path: str, name: str | None = None) -> dict:
    name = name or _read(f"{path}/{CURRENT}").decode()
    return json.loads(_read(f"{path}/{name}"))


def publish(path: str, name: str) -> None:
    """Makes a manifest the current one, by a rename."""
    at, root = opened(path)
    temp = f"{root}/.{uuid.uuid4().hex}"
    with at.open_output_stream(temp) as f:
        f.write(name.encode())
    at.move(temp, f"{root}/{CURRENT}")


@dataclass
class Block(InputPartition):
    path: str
    number: int
    offset: int
    length: int
    sha256: str
    rows: int
    dimension: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"].rstrip("/"), options

    def partitions(self) -> list[Block]:
        manifest = manifest_of(self.path, self.options.get("manifest"))
        for key in ("profile", "generation"):
            if self.options.get(key) is not None and manifest[key] != self.options[key]:
                raise ValueError(f"{self.path}: {key} is {manifest[key]}, not {self.options[key]}")
        out = []
        for name in manifest["segments"]:
            header, base = header_of(f"{self.path}/{name}")
            if (header["profile"], header["generation"], header["dimension"]) != (manifest["profile"], manifest["generation"], manifest["dimension"]):
                raise ValueError(f"{self.path}/{name}: header and manifest differ")
            for k, b in enumerate(header["blocks"]):
                out.append(Block(f"{self.path}/{name}", k, base + b["offset"], b["length"], b["sha256"], b["rows"], header["dimension"]))
        return out or [Block("", 0, 0, 0, "", 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            p = partition
            ids, vectors = block_of(p.path, p.number, p.offset, p.length, p.sha256, p.rows, p.dimension)
            ends = np.arange(p.rows + 1, dtype=np.int32) * p.dimension
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], names=["rowid", "vector"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int
    dimension: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.profile, self.generation = options["path"].rstrip("/"), options.get("profile", ""), options.get("generation", "0")
        self.block_rows, self.published, self.name = int(options.get("blockrows", 8192)), options.get("publish", "true") == "true", options.get("manifest") or f"manifest-{uuid.uuid4().hex}.json"
        at, root = opened(self.path)
        at.create_dir(root, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        at, root = opened(self.path)
        temp = f"{root}/.{uuid.uuid4().hex}"
        blocks, parts, dimension = [], [], None
        for batch in batches:
            for start in range(0, batch.num_rows, self.block_rows):
                piece = batch.slice(start, self.block_rows)
                flat = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                sizes = set(np.diff(piece.column(1).offsets.to_numpy()).tolist())
                dimension = min(sizes) if dimension is None else dimension
                if piece.column(0).null_count or piece.column(1).null_count or sizes != {dimension} or not np.isfinite(flat).all():
                    raise ValueError("a segment's rows have numbers and finite vectors of one dimension")
                raw = piece.column(0).to_numpy().astype("<i8").tobytes() + flat.tobytes()
                blocks.append({"rows": piece.num_rows, "offset": sum(len(p) for p in parts), "length": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})
                parts.append(raw)
        if not blocks:
            return Written(None, 0, 0)
        header = json.dumps({"schema": 1, "profile": self.profile, "generation": self.generation, "dimension": dimension, "dtype": "f32le", "blocks": blocks}, sort_keys=True).encode()
        whole = hashlib.sha256()
        with at.open_output_stream(temp) as f:
            for raw in (MAGIC, struct.pack("<I", len(header)), header, *parts):
                whole.update(raw)
                f.write(raw)
        uri = temp if ":/" not in self.path else self.path[: -len(root)] + temp
        read, base = header_of(uri)
        for k, b in enumerate(read["blocks"]):  # what was written is read back before it is reported
            block_of(uri, k, base + b["offset"], b["length"], b["sha256"], b["rows"], dimension)
        name = f"{whole.hexdigest()}.seg"
        at.move(temp, f"{root}/{name}")
        return Written(name, sum(b["rows"] for b in blocks), dimension)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.name]
        if len({m.dimension for m in done}) > 1:
            raise ValueError("segments of different dimensions")
        manifest = {"profile": self.profile, "generation": self.generation, "dimension": done[0].dimension if done else 0, "rows": sum(m.rows for m in done), "segments": sorted(m.name for m in done)}
        at, root = opened(self.path)
        with at.open_output_stream(f"{root}/{self.name}") as f:
            f.write(json.dumps(manifest, sort_keys=True).encode())
        if self.published:
            publish(self.path, self.name)

    def abort(self, messages: list[Written | None]) -> None:
        """Segments without a manifest are not read; they stay until the folder's retention removes them."""


class VectorSegments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(VectorSegments)
    return spark


def written(vectors: DataFrame, path: str, **options: str) -> None:
    """Writes (rowid, vector) as segments; see the options above."""
    registered(vectors.sparkSession)
    rows = vectors.select(F.col("rowid").cast("long").alias("rowid"), F.col("vector").cast("array<float>").alias("vector"))
    rows.write.format("vector_segment").options(path=path, **options).mode("append").save()


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return registered(spark).read.format("vector_segment").options(path=path, **options).load()


def content(vectors: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes, whatever their order."""
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("rowid", "vector").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return r.n, r.sum


def migrated(spark: SparkSession, old: str, new: str, **options: str) -> dict:
    """Copies the published segments to ``new`` and publishes them there once all rows have been read back and found equal."""
    source, manifest = read(spark, old), manifest_of(old)
    name = f"manifest-{uuid.uuid4().hex}.json"
    written(source, new, profile=manifest["profile"], generation=manifest["generation"], publish="false", manifest=name, **options)
    if content(source) != content(read(spark, new, manifest=name)):
        raise ValueError("the copy differs from its source")
    publish(new, name)
    return manifest_of(new)
