"""Vector code compression by Lloyd's rounds over partition-local heaps.

A vector's components become integers ``floor(scale * x)`` and the vector is cut into ``parts`` equal consecutive parts; each
position has a codebook, which starts as that part of the smallest identifiers' vectors. A round assigns every part to
its nearest entry and moves each entry to the floor of its parts' mean.

Parts are not compared with all entries in every round. When a part is assigned exactly, its distance to its own entry bounds
it from above and the distance to the second nearest from below; ``lower - upper`` is its slack. An entry that moves by ``p``
raises the upper bounds of its own parts by ``p`` and lowers all others' lower bounds by ``p`` at most, so the slack of
its parts falls by ``p + the largest movement among the other entries`` a round. That drift is summed for each entry. Each block
of vectors keeps a heap for each entry, ordered by slack plus the drift summed when the part was assigned: the parts whose
bounds the drift has violated are those on top. Only these are popped, compared with all entries exactly and pushed onto the
heap of their nearest entry. Sums and counts of the entries change by the parts that moved; those differences are summed in
Spark, a row for each number of the codebooks.

A block's vectors and heaps are one row of a table that each round reads and writes anew, so a round moves nothing but the
differences and any lost task is read again; the table of the round before is then deleted.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; null identifiers are encoded but
sort last among the starting vectors, and rows of one identifier start in order of their vectors; with fewer vectors than
entries each is an entry; distances tie to the lower entry; unused entries stay; an empty table gives an empty result; further
columns are not read. A ``ValueError`` tells of kept vectors that differ in length, that cannot be cut equally, or whose
distances could exceed 63 bits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, Tables, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors whose heaps are kept together.
BLOCK_VECTORS = 1 << 15
#: Share of a bound by which it is widened against rounding of square roots and sums.
ROUNDING = 1e-9


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.filter(x.isNotNull() & finite)


def integers(column: pa.Array, scale: int, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dimension)


class Heaps:
    """The heaps of a block: for each part position and entry an array of (key, row) in heap order."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray, parts: int, entries: int):
        self.parts, self.entries = parts, entries
        cut = np.cumsum(sizes)[:-1]
        self.arrays: list = list(zip(np.split(keys, cut), np.split(rows, cut), strict=True))
        self.lists: dict[int, list[tuple[float, int]]] = {}

    def opened(self, heap: int) -> list[tuple[float, int]]:
        if heap not in self.lists:
            keys, rows = self.arrays[heap]
            self.lists[heap] = list(zip(keys.tolist(), rows.tolist(), strict=True))
        return self.lists[heap]

    def violated(self, heap: int, drift: float) -> list[int]:
        """Pops the rows whose key the drift has reached."""
        keys, _ = self.arrays[heap]
        if not len(keys) or keys[0] > drift:
            return []
        queue, out = self.opened(heap), []
        while queue and queue[0][0] <= drift:
            out.append(heapq.heappop(queue)[1])
        return out

    def push(self, heap: int, key: float, row: int) -> None:
        heapq.heappush(self.opened(heap), (key, row))

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = [
            (np.array([k for k, _ in self.lists[h]], np.float64), np.array([r for _, r in self.lists[h]], np.int32)) if h in self.lists else self.arrays[h]
            for h in range(self.parts * self.entries)
        ]
        return np.array([len(k) for k, _ in pairs], np.int32), np.concatenate([k for k, _ in pairs]), np.concatenate([r for _, r in pairs])

    def owners(self, n: int) -> np.ndarray:
        """(part position, row) -> entry."""
        out = np.empty((self.parts, n), np.int64)
        for heap, (_, rows) in enumerate(self.arrays):
            rows = [r for _, r in self.lists[heap]] if heap in self.lists else rows
            out[heap // self.entries, rows] = heap % self.entries
        return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: in doubles while all sums stay below 2 ** 53, else in 64-bit integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * top * top * x.shape[1] < 2**53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def assign(x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, and its key on that entry's heap."""
    d = distances(x, book)
    own = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(d)), own])
    d[np.arange(len(d)), own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1)) if d.shape[1] > 1 else np.full(len(d), np.inf)
    finite = np.where(np.isinf(lower), 0, lower)
    return own, lower - upper + drift[own] - ROUNDING * (1 + finite + upper + drift[own])


def rescanned(x: np.ndarray, heaps: Heaps | None, books: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray]:
    """The heaps against moved entries, and what the moved parts change: (part position, entry, count and component sums)."""
    parts, entries, width = books.shape
    cut = x.reshape(len(x), parts, width)
    change = np.zeros((parts, entries, width + 1), np.int64)

    def counted(p: int, entry: np.ndarray, rows, sign: int) -> None:
        np.add.at(change[p, :, 0], entry, sign)
        np.add.at(change[p, :, 1:], entry, sign * cut[rows, p])

    if heaps is None:
        sizes, keys, rows = [], [], []
        for p in range(parts):
            own, key = assign(cut[:, p], books[p], drift[p])
            order = np.lexsort((key, own))  # ascending keys are a heap
            sizes.append(np.bincount(own, minlength=entries))
            keys.append(key[order])
            rows.append(order.astype(np.int32))
            counted(p, own, slice(None), 1)
        return Heaps(np.concatenate(sizes), np.concatenate(keys), np.concatenate(rows), parts, entries), change

    for p in range(parts):
        popped, was = [], []
        for e in range(entries):
            got = heaps.violated(p * entries + e, float(drift[p, e]))
            popped += got
            was += [e] * len(got)
        if not popped:
            continue
        rows, before = np.array(popped), np.array(was)
        own, key = assign(cut[rows, p], books[p], drift[p])
        for e, k, r in zip(own.tolist(), key.tolist(), popped, strict=True):
            heaps.push(p * entries + e, k, r)
        moved = own != before
        counted(p, own[moved], rows[moved], 1)
        counted(p, before[moved], rows[moved], -1)
    return heaps, change


_STATE = ["ids", "labels", "vectors", "sizes", "keys", "rows", "change"]


def _stored(ids: pa.Array, labels: pa.Array, x: np.ndarray, kind: str, heaps: Heaps, change: np.ndarray) -> pa.RecordBatch:
    def one(a: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

    arrays = [one(ids), one(labels), *(pa.array([v.tobytes()], pa.binary()) for v in (x.astype(kind), *heaps.stored())), pa.array([change.ravel().tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=_STATE)


def _first(books: np.ndarray, scale: int, kind: str):
    drift = np.zeros(books.shape[:2])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (pa.concat_arrays(t.column(k).chunks) for k in range(3))
        x = integers(vectors, scale, books.shape[0] * books.shape[2])
        return _stored(ids, labels, x, kind, *rescanned(x, None, books, drift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_VECTORS):
                held.append(batch.slice(start, BLOCK_VECTORS))
                n += held[-1].num_rows
                if n >= BLOCK_VECTORS:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _loaded(batch: pa.RecordBatch, k: int, kind: str, books: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray, Heaps]:
    ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
    ids, labels = pa.concat_arrays([ids]), pa.concat_arrays([labels])
    x, sizes, keys, rows = (np.frombuffer(batch.column(c)[k].as_py(), d) for c, d in (("vectors", kind), ("sizes", np.int32), ("keys", np.float64), ("rows", np.int32)))
    return ids, labels, x.reshape(len(ids), -1).astype(np.int64), Heaps(sizes, keys, rows, *books.shape[:2])


def _next(books: np.ndarray, drift: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, heaps = _loaded(batch, k, kind, books)
                yield _stored(ids, labels, x, kind, *rescanned(x, heaps, books, drift))

    return run


def _codes(books: np.ndarray, drift: np.ndarray, kind: str):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, heaps = _loaded(batch, k, kind, books)
                own = rescanned(x, heaps, books, drift)[0].owners(len(x))
                off = x.reshape(len(x), parts, width) - np.stack([books[p][own[p]] for p in range(parts)], axis=1)
                codes = [row.tobytes().hex() for row in own.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array((off * off).sum(axis=(1, 2)), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean; unused ones stay."""
    counts = sums[:, :, :1]
    return np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), books)


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The drift summed so far and this round's: an entry's own movement and the largest of the others."""
    off = (new - old).astype(np.float64)
    step = np.sqrt((off * off).sum(axis=2)) * (1 + ROUNDING)
    if step.shape[1] == 1:
        return drift + step
    ordered = np.sort(step, axis=1)
    others = np.where(step == ordered[:, -1:], ordered[:, -2:-1], ordered[:, -1:])
    return drift + step + others


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    kept = usable(vectors, vector_col).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    largest = F.max(F.abs(F.array_max("vector").cast("double"))), F.max(F.abs(F.array_min("vector").cast("double")))
    seen = kept.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.greatest(*largest).alias("top")).first()
    if seen.least is None:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width, rest = divmod(seen.least, parts)
    top = scale * (seen.top or 0.0) + 1
    if seen.least != seen.most or rest or not width or 4 * top * top * seen.least >= 2.0**63:
        raise ValueError(f"vectors of {seen.least} to {seen.most} components up to {seen.top} can't be cut into {parts} parts with distances of 63 bits")
    kind = "<i2" if top < 2**15 else "<i4"

    # The starting entries: a fixed number of rows.
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.stack([np.floor(np.array(r.vector, np.float64) * scale).astype(np.int64).reshape(parts, width) for r in start], axis=1)
    drift, sums = np.zeros(books.shape[:2]), np.zeros((*books.shape[:2], width + 1), np.int64)
    state = f"ids array<{id_type}>, labels array<{label_type}>, vectors binary, sizes binary, keys binary, rows binary, change array<bigint>"
    now = tables.written(kept.mapInArrow(_first(books, scale, kind), state), "round0")
    for k in range(rounds):
        changed = now.select(F.posexplode("change").alias("place", "by")).groupBy("place").agg(F.sum("by").alias("by"))
        for r in changed.collect():  # one row for each number of the codebooks
            sums.flat[r.place] += r.by
        new = moved_books(books, sums)
        drift, books = drifted(drift, books, new), new
        if k + 1 < rounds:
            now = tables.written(now.mapInArrow(_next(books, drift, kind), state), f"round{k + 1}")
            tables.delete(f"round{k}")
    coded = tables.written(now.mapInArrow(_codes(books, drift, kind), f"vec_id {id_type}, label {label_type}, code string, error bigint"), "coded")
    tables.delete(f"round{max(rounds - 1, 0)}")

    keyed = coded.withColumn("unlabelled", F.col("label").isNull()).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    totals = tables.written(keyed.groupBy("unlabelled", "key").agg(F.sum("error").alias("label_error")), "totals")
    few = totals.count() <= SMALL_IDS
    joined = keyed.join(F.broadcast(totals), ["unlabelled", "key"]) if few else spread_join(keyed, totals, ["unlabelled", "key"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
