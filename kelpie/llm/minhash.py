"""MinHash fingerprints of whole texts, and near pairs by signature bands.

A text's five-word shingles pass through ``PERMUTATIONS`` universal hash permutations ``a * x + b`` of 32-bit words, all at
once in numpy; the fingerprint keeps eight bits of each minimum, as hex. The likeness of two fingerprints is the share of
equal bytes, corrected for the one in 256 that agree by chance.

``edited_fingerprints`` needs each document's successor by identifier. Documents are range-partitioned once and sorted;
within a partition the next row is the successor, and only the last row of each partition waits for the first of the next.
Texts cross that exchange compressed with a dictionary made from at most ``DICTIONARY_TEXTS`` texts (a bounded sample that
only affects their size).

``near_groups`` joins documents on bands of their fingerprints in Spark and verifies the Jaccard similarity on whole
shingle sets, in the groups, stars and cells of the parity-sketch join. With ``BANDS`` bands of ``ROWS`` bytes a pair of
similarity 0.8 shares a band with probability above 0.9999. ``fingerprints`` gives both results.

Edge cases: a null or empty text has no shingles and the fingerprint of all ``f``; two such texts are alike (1), but in no
group with others; a text of fewer than five words is one shingle; repeated identifiers are ordered by a hash of their texts and
share the smallest of their groups; a row without an identifier has no group; a table of one row follows itself; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import jaccard
from .common import SMALL_IDS, written
from .shingles import mix, shingle_sets, text_chunks

PERMUTATIONS, BANDS, ROWS = 128, 25, 5
#: Texts that the dictionary of the exchange is made from, and its bytes.
DICTIONARY_TEXTS, DICTIONARY_BYTES = 4_000, 1 << 16
_rng = np.random.default_rng(128)
_A = (_rng.integers(0, 2**31, (PERMUTATIONS, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint32)
_BLOCK = 1024


def fingerprint(tokens: np.ndarray) -> bytes:
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    if not len(tokens):
        return b"\xff" * PERMUTATIONS
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), _BLOCK):
        np.minimum(low, (_A * x[k : k + _BLOCK] + _B).min(axis=1), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(12)
    low *= np.uint32(0x297A2D39)
    return (low >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    if x == y:
        return 1.0
    same = np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) / PERMUTATIONS
    return float(min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256))))


def edited(text: str, follower: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k]


_OUT = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _results(texts: list[str], followers: list[str], own: list[bytes], following: list[bytes]) -> list[list]:
    changed = [edited(t, f) for t, f in zip(texts, followers, strict=True)]
    theirs = list(map(fingerprint, shingle_sets(changed)))
    return [
        [len(t) for t in texts],
        [hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest() for c in changed],
        own,
        theirs,
        list(map(likeness, own, theirs)),
        list(map(likeness, own, following)),
    ]


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    raw = [t.encode("utf-8", "surrogatepass") for b in batches for t in b.column(0).to_pylist() if t]
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:  # too few texts to make one of
        made = b""
    yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])


def dictionary(docs: DataFrame, n_docs: int, text_col: str) -> bytes:
    """A compression dictionary from about DICTIONARY_TEXTS texts, chosen by a hash of their places."""
    chosen = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n_docs // DICTIONARY_TEXTS))) == 0
    sample = docs.filter(chosen).filter(F.octet_length(text_col).between(1, DICTIONARY_BYTES)).select(text_col).limit(2 * DICTIONARY_TEXTS)
    made = sample.repartition(1).mapInArrow(_dictionary, "made binary").collect()  # one row of DICTIONARY_BYTES at most
    return bytes(made[0].made) if made else b""


def _squeezed(words: bytes):
    """Texts compressed for the one exchange that carries them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress
        for batch in batches:
            for row, texts in text_chunks(batch.column(2)):
                small = pa.array([press((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), batch.column(1).slice(row, len(texts)), small], names=["doc_id", "tie", "small"])

    return run


def _along(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walked(batches, words)

    return run


def _walked(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by identifier. kind 0: a result; kind 1: the partition's last row; kind 2: its first."""
    import zstandard
    from pyspark import TaskContext

    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress

    part, held, kind_of = TaskContext.get().partitionId(), None, None

    def out(ids: pa.Array, kind: int, cols: list[list] | None, texts: list[str] | None) -> pa.RecordBatch:
        n = len(ids)
        cols = cols or [[None] * n for _ in _OUT]
        arrays = [pa.array(c, k) for c, (_, k) in zip(cols, _OUT, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), *arrays, pa.array(texts or [None] * n, pa.string())],
            names=["doc_id", "kind", "part", *(n for n, _ in _OUT), "text"],
        )

    for batch in batches:
        kind_of = batch.column(0).type
        for row, small in text_chunks(batch.column(2), 2 << 20):
            texts = [whole(t).decode("utf-8", "surrogatepass") for t in small]
            ids = batch.column(0).slice(row, len(texts)).to_pylist()
            if held is None:
                yield out(pa.array(ids[:1], kind_of), 2, None, texts[:1])
            prints = list(map(fingerprint, shingle_sets(texts)))
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = (ids[-1], texts[-1], prints[-1])
            if len(ids) > 1:
                yield out(pa.array(ids[:-1], kind_of), 0, _results(texts[:-1], texts[1:], prints[:-1], prints[1:]), None)
    if held is not None:
        yield out(pa.array([held[0]], kind_of), 1, None, [held[1]])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, followers = batch.column("text").to_pylist(), batch.column("follower").to_pylist()
        own, following = (list(map(fingerprint, shingle_sets(x))) for x in (texts, followers))
        cols = _results(texts, followers, own, following)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(cols, _OUT, strict=True))], names=["doc_id", *(n for n, _ in _OUT)])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, both fingerprints and both likenesses."""
    return _in_hex(_edited(docs, id_col, text_col))


def _in_hex(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.lower(F.hex(c)).alias(c) if k == "binary" and c != "doc_id" else F.col(c) for c, k in rows.dtypes))


def _edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``edited_fingerprints`` with hashes and fingerprints as bytes."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sql = {pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double"}
    schema = ", ".join(f"{n} {sql[k]}" for n, k in _OUT)
    n_docs = docs.count()
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // 20_000 + 1)
    words = dictionary(docs, n_docs, text_col)
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
        .mapInArrow(_squeezed(words), f"doc_id {id_type}, tie bigint, small binary")
        .repartitionByRange(n_parts, "doc_id")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(_along(words), f"doc_id {id_type}, kind int, part int, {schema}, text string"),
        "fingerprints",
    )
    # One first and one last row for each partition.
    ends = rows.filter("kind > 0").select("doc_id", "kind", "part", "text")
    order = Window.orderBy("part")
    firsts = ends.filter("kind = 2").select("part", F.col("text").alias("follower"))
    parts = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    followed = parts.join(firsts.withColumnRenamed("part", "next"), "next").drop("next")
    last = ends.filter("kind = 1").join(followed, "part").select("doc_id", "text", "follower").mapInArrow(_joined, f"doc_id {id_type}, {schema}")
    return rows.filter("kind = 0").select("doc_id", *(n for n, _ in _OUT)).union(last)


def band_words(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit word for each band of the fingerprint."""
    rows = np.frombuffer(fingerprint(tokens), dtype=np.uint8)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, from verified links among documents that share a band."""
    return jaccard.near_groups(docs, id_col, text_col, band_words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_fingerprints`` with ``near_id``: the smallest document of the verified group that bands bring together.

    Up to SMALL_IDS documents of groups are broadcast to the fingerprints; more are joined, with fingerprints still in bytes.
    """
    groups = near_groups(docs, id_col, text_col).filter("doc_id <> component_id")
    groups = groups.groupBy(F.col("doc_id").alias("member")).agg(F.min("component_id").alias("near"))
    groups = F.broadcast(groups) if groups.count() <= SMALL_IDS else groups
    rows = _edited(docs, id_col, text_col)
    joined = rows.join(groups, F.col("doc_id") == F.col("member"), "left")
    return _in_hex(joined.select(*rows.columns, F.coalesce("near", F.col("doc_id").cast("long")).alias("near_id")))
