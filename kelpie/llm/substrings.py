"""Substring dedup by level-wise doubling of word windows.

A window of ``window`` consecutive words is removed when its word sequence starts at any other place of the corpus. Windows
grow by levels: lengths halve from ``window`` down to ``shortest`` (35, 18, 9), and the search goes up. At the first level all
windows of that length are counted; at each next one a place is a candidate only if the windows of the length before that
make up the longer one were both repeated. Levels end when no candidates survive or at ``window``.

Texts move once, compressed, into a table of blocks that is bucketed by block. A level sends hashes only: each block sends the
distinct hashes of its candidates, dealt to tasks by their first bits, so a sequence that a third of all documents share is one
number a block. A task compares what it got and answers each block with one bit a hash. Answers are joined to the blocks'
buckets, where the texts lie already. Before the last level a false alarm costs only a candidate, so 40 bits and those
of the deal are sent; the last level sends 64 and is dealt by the bits of a second hash. A row holds what a block has for a task, so rows
are never more than hashes, however many blocks and tasks there are; blocks and tasks are of fixed size, so memory is too.

Edge cases: a null or empty text has no words; a text of fewer words than a window keeps all of them; repeated rows and copies
inside a document are other places, so they are removed too; a null or repeated identifier names its own row; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .shingles import CHUNK_BYTES, mix, text_chunks, word_hashes

WINDOW, SHORTEST = 35, 9
#: Bytes of text in a block, and hashes that one task should compare.
BLOCK_BYTES, TASK_HASHES = 8 << 20, 1 << 21
#: Bits of a hash that are sent before the last level, besides those that deal it.
SENT_BITS = 40

_U = np.uint64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def halved(window: int, shortest: int) -> list[int]:
    """Lengths that halve from ``window`` until ``shortest``, ascending."""
    out = [window]
    while out[0] > max(1, shortest):
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(words: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on; a window's hash is made of those of its two halves."""
    h, have = mix(words ^ _U(salt)), 1
    for n in halved(length, 1)[1:]:
        h, have = mix(h[: len(h) - (n - have)] * _LEFT + mix(h[n - have :] + _RIGHT + _U(n))), n
    return h


class Block:
    """The words of a block's documents as hashes, and which windows are still candidates."""

    def __init__(self, texts: list[bytes]):
        parts, bounds, part, size = [], [0], [], 0
        for t in [*texts, None]:
            if part and (t is None or size + len(t) > CHUNK_BYTES):
                h, starts = word_hashes(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
                ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in part]))
                bounds += (bounds[-1] + ends).tolist()
                parts.append(h)
                part, size = [], 0
            if t is not None:
                part.append(t)
                size += len(t)
        self.words = np.concatenate(parts) if parts else np.empty(0, _U)
        self.bounds = np.array(bounds)
        self.room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.words))
        self.alive: np.ndarray | None = None

    def places(self, length: int, before: int) -> np.ndarray:
        """Starts of the candidates of ``length``; both windows of the length before that make them up were repeated."""
        fit = self.room >= length
        if self.alive is not None:
            grown = length - before
            fit[: max(0, len(fit) - grown)] &= self.alive[: max(0, len(fit) - grown)] & self.alive[grown:]
        return np.flatnonzero(fit)

    def hashes(self, places: np.ndarray, length: int, bits: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (task, hash) in order, the number of each place's, and their counts."""
        if not len(places):
            return (np.empty(0, np.int64), np.empty(0, _U), *(np.empty(0, np.int64),) * 2)
        h = window_hashes(self.words, length, 0)[places]
        if last:
            task = (window_hashes(self.words, length, 0x5EED)[places] >> _U(63 - bits) >> _U(1)).astype(np.int64)
        else:
            h = h >> _U(64 - SENT_BITS - bits)
            task = (h >> _U(SENT_BITS)).astype(np.int64)
        order = np.lexsort((h, task)) if last else np.argsort(h, kind="stable")
        t, v = task[order], h[order]
        new = np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1]))
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        return t[firsts], v[firsts], number, np.diff(np.append(firsts, len(h)))

    def answered(self, level: list[tuple[int, bytes]], places: np.ndarray, length: int, bits: int, last: bool) -> None:
        """Only the repeated candidates stay: those with several places here, or with a bit of the answers."""
        task, _, number, counts = self.hashes(places, length, bits, last)
        repeated = counts > 1
        for t, answer in level:
            a, b = np.searchsorted(task, [t, t + 1])
            repeated[a:b] |= np.unpackbits(np.frombuffer(answer, np.uint8), count=b - a).astype(bool)
        self.alive = np.zeros(len(self.words), bool)
        self.alive[places[repeated[number]]] = True


def sent(values: np.ndarray, last: bool) -> bytes:
    """Sorted hashes of one task: all bytes of the last level's, else the first byte of each and then the rest."""
    if last:
        return values.astype("<u8").tobytes()
    low = values & _U((1 << SENT_BITS) - 1)
    return (low >> _U(32)).astype(np.uint8).tobytes() + (low & _U(0xFFFFFFFF)).astype("<u4").tobytes()


def received(data: bytes, last: bool) -> np.ndarray:
    if last:
        return np.frombuffer(data, "<u8")
    n = len(data) // 5
    return (np.frombuffer(data, np.uint8, n).astype(_U) << _U(32)) | np.frombuffer(data, "<u4", n, n).astype(_U)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    press, block = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 33
    for batch in batches:
        for row, texts in text_chunks(batch.column(1).cast(pa.binary()), BLOCK_BYTES):
            texts = [t or b"" for t in texts]
            ids = pa.concat_arrays([batch.column(0).slice(row, len(texts))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([list(map(len, texts))], pa.list_(pa.int64())),
                    pa.array([sum(len(t.split()) for t in texts)], pa.int64()),
                    pa.array([press(b"".join(texts))], pa.binary()),
                ],
                names=["block", "ids", "sizes", "n_words", "texts"],
            )
            block += 1


def _texts(batch: pa.RecordBatch, k: int) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(batch.column("texts")[k].as_py())
    ends = np.cumsum(batch.column("sizes")[k].as_py())
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _at_level(batch: pa.RecordBatch, k: int, texts: list[bytes], lengths: list[int], done: int, bits: int) -> Block:
    """The block after the answers of the first ``done`` levels."""
    block = Block(texts)
    answers = batch.column("answers")[k].as_py() or [] if done else []
    for level in range(done):
        length, before = lengths[level], lengths[level - 1] if level else 0
        own = [(a["task"], a["repeated"]) for a in answers if a["level"] == level]
        block.answered(own, block.places(length, before), length, bits, level == len(lengths) - 1)
    return block


def _asked(lengths: list[int], level: int, bits: int):
    length, before, last = lengths[level], lengths[level - 1] if level else 0, level == len(lengths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _at_level(batch, k, _texts(batch, k), lengths, level, bits)
                task, value, _, counts = block.hashes(block.places(length, before), length, bits, last)
                if len(task):
                    firsts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
                    data = [sent(v, last) for v in np.split(value, firsts[1:])]
                    own = np.maximum.reduceat(counts, firsts) > 1
                    columns = [pa.array(task[firsts], pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(data), pa.int64()), pa.array(own), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "block", "own", "hashes"])

    return run


def _compared(level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[int, bool, np.ndarray]]] = {}
        for batch in batches:
            for task, block, own, data in zip(*(batch.column(c).to_pylist() for c in ("task", "block", "own", "hashes")), strict=True):
                got.setdefault(task, []).append((block, own, received(data, last)))
        for task, rows in got.items():
            every = np.sort(np.concatenate([v for _, _, v in rows]))
            twice = every[1:][every[1:] == every[:-1]]
            for block, own, v in rows:
                if own or len(twice):  # a block with repeats of its own is answered too, so an empty table means that none survive
                    repeated = np.append(twice, _U(0))[np.searchsorted(twice, v)] == v if len(twice) else np.zeros(len(v), bool)
                    if own or repeated.any():
                        row = [pa.array([block], pa.int64()), pa.array([level], pa.int32()), pa.array([task], pa.int32()), pa.array([np.packbits(repeated).tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, names=["block", "level", "task", "repeated"])

    return run


def _kept(lengths: list[int], bits: int, done: int):
    def spans_of(covered: np.ndarray) -> list[dict]:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        return [{"start": int(a), "length": int(b - a)} for a, b in edge.reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                texts = _texts(batch, k)
                block = _at_level(batch, k, texts, lengths, done, bits)
                starts = np.flatnonzero(block.alive)  # none if the levels ended early
                step = np.zeros(len(block.words) + 1, np.int64)
                step[starts] += 1
                step[starts + lengths[-1]] -= 1
                cover = np.cumsum(step[:-1]) > 0
                kept, spans, removed = [], [], []
                for text, a, b in zip(texts, block.bounds[:-1], block.bounds[1:], strict=True):
                    own = cover[a:b]
                    removed.append(int(own.sum()))
                    spans.append(spans_of(own) if removed[-1] else [])
                    kept.append(b" ".join(compress(text.split(), ~own) if removed[-1] else text.split()))
                ids = pa.concat_arrays([batch.column("ids")[k].values])
                cols = [pa.array(np.diff(block.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, the removed ``spans`` of words, and kept_text, its other words joined by a space."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    lengths = halved(window, shortest)
    blocks = tables.bucketed(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_blocks, f"block bigint, ids array<{id_type}>, sizes array<bigint>, n_words bigint, texts binary"),
        "blocks", "block",
    )
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // TASK_HASHES + 1)
    bits = (tasks - 1).bit_length()

    answers, done, alive = [], 0, True
    while alive and done < len(lengths):
        last = done == len(lengths) - 1
        asked = _with(blocks, answers).mapInArrow(_asked(lengths, done, bits), "task int, block bigint, own boolean, hashes binary")
        told = asked.repartitionById(1 << bits, F.col("task")).mapInArrow(_compared(done, last), "block bigint, level int, task int, repeated binary")
        answers.append(tables.written(told, f"level{done}"))
        done += 1
        alive = not answers[-1].isEmpty()
    out = f"doc_id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start bigint, length bigint>>, kept_text string"
    return _with(blocks, answers).mapInArrow(_kept(lengths, bits, done), out)


def _with(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with the answers that they got: at most a bit for each word and level."""
    if not answers:
        return blocks
    every = answers[0]
    for a in answers[1:]:
        every = every.union(a)
    return blocks.join(every.groupBy("block").agg(F.collect_list(F.struct("level", "task", "repeated")).alias("answers")), "block", "left")
