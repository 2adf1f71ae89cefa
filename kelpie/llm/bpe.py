"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

A text is split by the pattern; each distinct word is encoded once per batch. The recursive query holds one row per word
and step; its token positions join the merge table, the pair of lowest rank (leftmost on ties) of each word is
contracted, and words without a pair left stop. Decoding looks ids up and concatenates their bytes with an ordered
aggregation. Encoded words are kept in a cache of a fixed number of entries, so memory is bounded however many words the
corpus has.

A word's steps grow with its length, so the query holds words in segments of ``SEGMENT`` bytes that overlap their neighbours
by ``OVERLAP`` on either side (most words are one segment). Two segments join at a token that both have at the same place.
That is exact: an encoding is the right one if every two tokens side by side are what their bytes alone encode to, any
part of a right encoding is right itself, and the joined encoding has only pairs of tokens that one of its segments has.
A word with two segments that have no token in common (long runs of one symbol) is encoded whole by a query that contracts in a
step all pairs of the word's lowest rank, from the left; its steps are the distinct ranks met, few in such runs. That order could
differ from one pair at a time where a token is made of a later one, so the same rule checks it: every two tokens side by side
must be what their bytes alone encode to. Only a word that fails is done with longer segments.

Edge cases: a null text is the empty text, with no ids; repeated rows give repeated results; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_chunks

SEGMENT, OVERLAP = 128, 32
CACHE_WORDS = 500_000
#: Memory of a worker's database, and what a run encoded whole may take besides, for each of its bytes.
MEMORY_MB, RUN_BYTES = 256, 200
#: Words (or segments) and, in longer segments, bytes that one query holds.
QUERY_WORDS, QUERY_BYTES = 20_000, 300_000

ENCODE = """
WITH RECURSIVE steps(word, step, toks) AS (
    SELECT word, 0, toks FROM init
  UNION ALL
    SELECT s.word, s.step + 1, s.toks[:b.best % 65536 - 1] || [(b.best // 65536)::INTEGER] || s.toks[b.best % 65536 + 2:]
    FROM steps s JOIN (
        SELECT p.word, min(m.merged::BIGINT * 65536 + p.pos) AS best
        FROM (
            SELECT word, unnest(range(1, len(toks))) AS pos,
                   unnest(list_transform(range(1, len(toks)), lambda i: toks[i]::BIGINT * 65536 + toks[i + 1])) AS pair
            FROM steps
        ) p JOIN merges m ON p.pair = m.pair
        GROUP BY p.word
    ) b ON s.word = b.word
), ended AS (SELECT word, arg_max(toks, step) AS toks FROM steps GROUP BY word),
places AS (SELECT word, unnest(toks) AS id, unnest(range(len(toks))) AS pos FROM ended)
SELECT e.word, e.toks, d.bytes
FROM ended e JOIN (
    SELECT p.word, string_agg(v.hex, '' ORDER BY p.pos) AS bytes FROM places p JOIN vocabulary v ON p.id = v.id GROUP BY p.word
) d ON e.word = d.word
ORDER BY e.word
"""

#: All pairs of the lowest rank in a step; in a chain of overlapping ones every second stays.
ENCODE_RUNS = """
WITH RECURSIVE steps(step, toks) AS (
    SELECT 0, toks FROM init
  UNION ALL
    SELECT step + 1, list(tok ORDER BY pos) FROM (
        SELECT step, pos, if(hit, best, tok) AS tok, lag(hit, 1, false) OVER (ORDER BY pos) AS eaten FROM (
            SELECT *, lowest AND (pos - max(if(lowest, NULL, pos)) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS hit FROM (
                SELECT *, coalesce(merged = best, false) AS lowest FROM (
                    SELECT p.*, m.merged, min(m.merged) OVER () AS best FROM (
                        SELECT step, unnest(range(0, len(toks) + 1)) AS pos, unnest([NULL] || toks) AS tok, unnest([NULL] || toks[2:] || [NULL]) AS following FROM steps
                    ) p LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 65536 + p.following
                ) WHERE best IS NOT NULL
            )
        )
    ) WHERE NOT eaten AND tok IS NOT NULL GROUP BY step
), ended AS (SELECT arg_max(toks, step) AS toks FROM steps)
SELECT toks, (SELECT string_agg(v.hex, '' ORDER BY p.pos) FROM (SELECT unnest(toks) AS id, unnest(range(len(toks))) AS pos FROM ended) p JOIN vocabulary v USING (id)) AS bytes FROM ended
"""


class Codec:
    """Encodes distinct words; ``ids`` and ``decoded`` map a word to its ids and to the bytes these decode to."""

    def __init__(self, ranks_file: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # White space as Unicode defines it; \s of this module has four control characters more.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.token = {r: b for b, r in self.ranks.items()}
        self.length = np.zeros(max(self.token) + 1, dtype=np.int64)
        for r, b in self.token.items():
            self.length[r] = len(b)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        merges = np.array(
            [(self.ranks[b[:i]] << 16 | self.ranks[b[i:]], r) for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks],
            dtype=np.int64,
        ).reshape(-1, 2)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB"})
        merge_table = pa.table({"pair": merges[:, 0], "merged": merges[:, 1]})  # noqa: F841
        vocabulary_table = pa.table({"id": list(self.token), "hex": [b.hex() for b in self.token.values()]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT pair, merged::INTEGER AS merged FROM merge_table")
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, hex FROM vocabulary_table")
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def contracted(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each piece and the bytes they decode to."""
        ends = np.zeros(len(pieces) + 1, dtype=np.int32)
        np.cumsum([len(raw) for raw in pieces], out=ends[1:])
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        init = pa.table({"word": np.arange(len(pieces), dtype=np.int32), "toks": pa.ListArray.from_arrays(ends, symbols)})
        self.db.register("init", init)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out = self.db.execute(ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("init")
        toks = out.column("toks").combine_chunks()
        flat, at = toks.values.to_numpy().astype("<u4"), toks.offsets.to_numpy()
        for a, b, hexed in zip(at[:-1], at[1:], out.column("bytes").to_pylist(), strict=True):
            yield flat[a:b], bytes.fromhex(hexed)

    def learn(self, words: list[str], segment: int = SEGMENT) -> None:
        """Encodes words, those of more bytes than a segment and its overlaps in several."""
        overlap = segment * OVERLAP // SEGMENT
        short, long = [], []
        for w in words:
            raw = w.encode()
            (short if len(raw) <= segment + 2 * overlap else long).append((w, raw))
        for k in range(0, len(short), QUERY_WORDS):
            part = short[k : k + QUERY_WORDS]
            for (w, _), (ids, raw) in zip(part, self.contracted([raw for _, raw in part]), strict=True):
                self.ids[w], self.decoded[w] = ids.tobytes(), raw
        again = []
        per_query = max(1, QUERY_BYTES // (segment + 2 * overlap))
        for w, raw in long:
            starts = [max(0, k - overlap) for k in range(0, len(raw), segment)]
            pieces = [raw[a : k + segment + overlap] for a, k in zip(starts, range(0, len(raw), segment), strict=True)]
            done = [x for k in range(0, len(pieces), per_query) for x in self.contracted(pieces[k : k + per_query])]
            if (joined := self.joined(starts, done)) is None:
                again.append(w)
            else:
                self.ids[w], self.decoded[w] = joined
        failed = [w for w in again if not self.learn_run(w)]
        if failed:
            self.learn(failed, segment * 4)

    def learn_run(self, word: str) -> bool:
        """Encodes a word whole, all pairs of its lowest rank in a step; False if two tokens aren't what their bytes encode to."""
        raw = word.encode()
        self.db.register("init", pa.table({"toks": pa.array([self.first[np.frombuffer(raw, dtype=np.uint8)]], pa.list_(pa.int32()))}))
        self.db.execute(f"SET memory_limit = '{MEMORY_MB + RUN_BYTES * len(raw) // 1_000_000}MB'")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out = self.db.execute(ENCODE_RUNS).to_arrow_table()
        self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        self.db.unregister("init")
        ids = np.asarray(out.column("toks")[0].as_py(), dtype="<u4")
        pairs = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:])
        sides = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs]
        alone = self.contracted([self.token[a] + self.token[b] for a, b in sides]) if sides else []
        if any(list(got) != list(want) for (got, _), want in zip(alone, sides, strict=True)):
            return False
        self.ids[word], self.decoded[word] = ids.tobytes(), bytes.fromhex(out.column("bytes")[0].as_py())
        return True

    def joined(self, starts: list[int], pieces: list[tuple[np.ndarray, bytes]]) -> tuple[bytes, bytes] | None:
        """Ids and decoded bytes of a word from its segments, or None where neighbours share no token."""
        ids, back, enter = [], [], 0
        for k, (toks, raw) in enumerate(pieces):
            ends = np.cumsum(self.length[toks])
            places = np.append(0, ends[:-1])
            leave, following = len(toks), 0
            if k + 1 < len(pieces):
                other = pieces[k + 1][0]
                other_ends = np.cumsum(self.length[other]) + starts[k + 1]
                spans = (places + starts[k] << 20) + self.length[toks]
                theirs = (other_ends - self.length[other] << 20) + self.length[other]
                common, at, to = np.intersect1d(spans, theirs, assume_unique=True, return_indices=True)
                usable = np.flatnonzero(at >= enter)
                if not len(usable):
                    return None
                leave, following = int(at[usable[0]]), int(to[usable[0]])
            if leave > enter:
                ids.append(toks[enter:leave].tobytes())
                back.append(raw[places[enter] : ends[leave - 1]])
            enter = following
        return b"".join(ids), b"".join(back)

    def run(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the bytes they decode to."""
        words = self.split(text)
        self.ensure(set(words))
        return b"".join(map(self.ids.__getitem__, words)), b"".join(map(self.decoded.__getitem__, words))

    def ensure(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        if new:
            if len(self.ids) + len(new) > CACHE_WORDS:
                # Only the words in use stay.
                self.ids = {w: self.ids[w] for w in words - new}
                self.decoded = {w: self.decoded[w] for w in self.ids}
            self.learn(list(new))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    key = (ranks_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def _mapped(ranks_file: str, pattern: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in batches:
            for row, texts in text_chunks(batch.column(1), 4 << 20):
                split = [c.split(t or "") for t in texts]
                c.ensure(set().union(*split))
                ids = [b"".join(map(c.ids.__getitem__, words)) for words in split]
                back = [b"".join(map(c.decoded.__getitem__, words)) for words in split]
                arrays = [batch.column(0).slice(row, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if full:
                    arrays += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                else:
                    arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in v]) for v in (ids, back)]
                yield pa.RecordBatch.from_arrays(arrays, names=names(full))

    return run


def names(full: bool) -> list[str]:
    return ["doc_id", "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))]


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, ids and decoded bytes; with ``full`` off, digests in their place."""
    kinds = ("array<int>", "binary") if full else ("string", "string")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names(full), (docs.schema[id_col].dataType.simpleString(), "bigint", *kinds), strict=True))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_mapped(ranks_file, pattern, full), schema)
