"""Best-fit packing planned on the histogram of lengths.

Documents become token ids with a closing id; only documents longer than a sequence are cut, into full pieces after a
shorter first one. The plan never looks at documents: best-fit decreasing runs over *counts* of lengths, so a group of
open sequences with the same room is one entry however many sequences it has. The plan has at most one entry per length
and group, a bound that depends on the sequence length and not on the corpus. Pieces then take their places by their rank
within their length: the rank inside an input partition is counted while tokenising, and a join adds the number of
pieces of that length in the partitions before it, so no task gathers all pieces of a length.

Ids come from the merge ranks with ``tiktoken``, and with the added tokens of the JSON file of the same vocabulary, which
match anywhere in a text, the ids of ``tokenizers`` with that file (tested on whole tables) at four times its speed.

Edge cases: a null or empty text is one piece with the closing id alone; repeated rows are packed as separate documents;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_totals, written
from .shingles import text_chunks

CAPACITY = 2048


def added_tokens(json_file: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file with their ids; only plain ones, matched as they stand."""
    with open(json_file, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they stand")
    return {t["content"]: t["id"] for t in tokens}


def encoder(ranks_file: str, pattern: str, added: dict[str, int] | None = None):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document with n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenise(ranks_file: str, pattern: str, capacity: int, end_id: int, added: dict[str, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(ranks_file, pattern, added)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            for row, texts in text_chunks(batch.column(1)):
                at, cols = [], ([], [], [], [], [])
                for k, text in enumerate(texts):
                    tokens = np.append(enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4"), np.uint32(end_id))
                    for j, (start, length) in enumerate(pieces_of(len(tokens), capacity)):
                        at.append(row + k)
                        for c, v in zip(cols, (j, start, length, zlib.crc32(tokens[start : start + length].tobytes()), seen[length]), strict=True):
                            c.append(v)
                        seen[length] += 1
                piece, start, length, crc, rank = cols
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def best_fit_plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its slots in order of rank: (first rank, copies per sequence, first sequence, offset)."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups of (first sequence, number of sequences)
    rooms: list[int] = []  # the keys of room, in order
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    n_sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank, slots = histogram[length], 0, plan.setdefault(length, [])
        while todo:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            else:
                left, first, n = capacity, n_sequences, -(-todo // (capacity // length))
                n_sequences += n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append((rank, each, first, capacity - left))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, first, full)
            if full < n and 0 < todo < each:
                slots.append((rank, todo, first + full, capacity - left))
                put(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            put(left, first + full, n - full)
    return plan


def _placed(plan: dict[int, list[tuple[int, int, int, int]]]):
    arrays = {length: np.array(slots, dtype=np.int64).T.copy() for length, slots in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                firsts, each, base, off = arrays[int(one)]
                rows = np.flatnonzero(length == one)
                slot = np.searchsorted(firsts, rank[rows], side="right") - 1
                nth = rank[rows] - firsts[slot]
                sequence[rows] = base[slot] + nth // each[slot]
                offset[rows] = off[slot] + nth % each[slot] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, ranks_file: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``added`` tokens have ids of their own."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _tokenise(ranks_file, pattern, capacity, end_id, added), f"{schema}, part int, rank bigint"
        ),
        "pieces",
    )
    counts = pieces.groupBy("part", "length").count()
    # At most one row for each possible length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = prefix_totals(counts, ["part"], "count", "before", ["length"]).drop("count")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    return ranked.mapInArrow(_placed(best_fit_plan(histogram, capacity)), f"{schema}, sequence_id bigint, offset bigint")
